"""Clustering of vectors around centroids by sort-means (operator 12).

In a round every centroid lists the others in the order of their distance from it. A vector
starts from the centroid of its last assignment, at the distance d, and goes through that
list; centroids strictly farther than 2d from the start are farther from the vector than d,
so it stops there. One at exactly 2d is still looked at, as it may tie with a smaller number.

A round is one pass over a Parquet table of the vectors and their last assignment, which
writes the next one and deletes the one before; a task adds up its vectors by centroid, and
Spark adds these sums. Only the k centroids are on the driver and go to the tasks, k times
the vector's length in numbers; of the vectors nothing is collected or shuffled.

Arithmetic is exact: components become floor(scale * x), in 64 bits where squared distances
fit, else as Python integers; sums have 38 digits.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part; components beyond +-2^62 count as that, distances and sums of them
beyond 2^63 - 1 as that; rows of equal or null ids are vectors of their own (a null id hashes
as the seed and the colon alone); of equal hashes the smaller vector is the earlier centroid;
fewer vectors than k make as many centroids; ties go to the smaller centroid; an empty
centroid stays where it is; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, remove, shared_folder, ship

FAR = 1 << 62
LONG = (1 << 63) - 1
ROWS_AT_ONCE = 8192


def quantised(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, terms array<long>) of the rows that take part."""
    terms = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = ~F.exists(terms, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A double beyond the bounds, not one of them: floor would be beyond 64 bits.
    held = lambda x: F.when(x >= float(FAR), F.lit(FAR)).when(x <= -float(FAR), F.lit(-FAR)).otherwise(F.floor(x))
    return df.filter((F.size(vector) == dims) & whole).select(F.col(vec_id).alias("vec_id"), F.transform(terms, lambda x: held(x * scale).cast("long")).alias("terms"))


def exact(most: int, dims: int) -> bool:
    """Whether four times a squared distance fits 64 bits, with components of at most this size."""
    return 4 * dims * (2 * most) ** 2 <= LONG


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = rows - centroid
    return (off * off).sum(axis=1)


class Centroids:
    """The centroids of one round with, for each, the numbers of all others by distance."""

    def __init__(self, centroids: list[list[int]], kind: type) -> None:
        self.at = np.array(centroids, dtype=kind)
        self.apart = [squared(self.at, c) for c in self.at]
        self.order = [np.array(sorted(range(len(self.at)), key=lambda j: (d[j], j))) for d in self.apart]
        self.looked_at = 0

    def assign(self, rows: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance, beginning at ``last``."""
        best, least = last.copy(), np.zeros(len(rows), dtype=rows.dtype)
        for c in np.unique(last):
            mine = np.flatnonzero(last == c)
            part, near, found = rows[mine], np.full(len(mine), c), squared(rows[mine], self.at[c])
            start, order = found.copy(), self.order[c]
            # Squares: strictly farther than twice the distance is more than four times the square.
            reach = np.searchsorted(self.apart[c][order], 4 * start, side="right")
            for step in range(len(order)):
                go = np.flatnonzero(reach > step)
                if not len(go):
                    break
                j = order[step]
                if j == c:
                    continue
                self.looked_at += len(go)
                d = squared(part[go], self.at[j])
                better = (d < found[go]) | ((d == found[go]) & (j < near[go]))
                near[go[better]], found[go[better]] = j, d[better]
            best[mine], least[mine] = near, found
        return best, least


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of the session's size, joined to ROWS_AT_ONCE rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` (vec_id, terms, cluster) with the nearest centroid as ``cluster`` and the squared ``distance``."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, terms array<bigint>, cluster int, distance long"
    most = max(abs(x) for c in centroids for x in c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: dict[type, Centroids] = {}
        for t in _gathered(batches):
            terms = _matrix(t["terms"].chunk(0))
            kind = np.int64 if exact(max(most, int(terms.max()), -int(terms.min())), terms.shape[1]) else object
            how = prepared.setdefault(kind, Centroids(centroids, kind))
            cluster, distance = how.assign(terms.astype(kind), t["cluster"].to_numpy().astype(np.int64))
            distance = np.minimum(distance, LONG).astype(np.int64)
            out = pa.table({"vec_id": t["vec_id"], "terms": t["terms"], "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})
            yield from out.to_batches(ROWS_AT_ONCE)

    return rows.mapInArrow(run, schema)


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By centroid the number of its vectors and the sum of each component: a row of each task and centroid, added by Spark."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for t in _gathered(batches):
            terms, cluster = _matrix(t["terms"].chunk(0)), t["cluster"].to_numpy()
            wide = terms if len(terms) * max(int(terms.max()), -int(terms.min())) <= LONG else terms.astype(object)
            for c in np.unique(cluster).tolist():
                part = wide[cluster == c]
                n, total = held.get(c, (0, [0] * part.shape[1]))
                held[c] = (n + len(part), [a + int(b) for a, b in zip(total, part.sum(axis=0), strict=True)])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()]), pa.array([s for _, s in held.values()], schema.field("sums").type)], schema=schema)

    partial = rows.select("terms", "cluster").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    each = partial.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(each.collect(), key=lambda r: (r.cluster, r.at)):  # k centroids by the vector's length
        found.setdefault(r.cluster, (r.n, []))[1].append(int(r.x))
    return found


def moved(centroids: list[list[int]], found: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """The floors of the means; centroids without vectors stay."""
    return [[x // found[i][0] for x in found[i][1]] if i in found else c for i, c in enumerate(centroids)]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    spark = df.sparkSession
    ship(spark)
    rows = quantised(df, vec_id, vector, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [r.terms for r in rows.select("terms", name.alias("name")).orderBy("name", "terms").limit(k).collect()]
    now = rows.withColumn("cluster", F.lit(0))
    if not centroids:
        none = [F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
        return now.select("vec_id", "cluster", *none, F.lit("").alias("centroid_sha256"))
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    try:
        for i in range(rounds + 1):
            assigned(now, centroids).write.parquet(f"{folder}/{i}")
            now = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
            if i < rounds:
                centroids = moved(centroids, sums(now))
                now = now.drop("distance")
        within = {r.cluster: int(r.inertia) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k numbers
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
        held = [min(within.get(i, 0), LONG) for i in range(len(centroids))]
        whole = F.lit(min(sum(within.values()), LONG)).cast("long")
        return checkpointed(now.select("vec_id", "cluster", "distance", of(held).cast("long").alias("cluster_inertia"), whole.alias("inertia"), of(digest).alias("centroid_sha256")))
    finally:
        remove(spark, folder)


def sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """All rounds in one engine, each vector against each centroid."""
    far = "list_sum(list_transform(list_zip(v.t, c.t), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), t) - 1 AS INTEGER) AS cluster, t FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, v.t AS t, cluster, CAST({far} AS BIGINT) AS distance FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, d, CAST(floor(CAST(sum(x) AS HUGEINT) / count(*)) AS BIGINT) AS x FROM (SELECT cluster, unnest(range({dims})) AS d, unnest(t) AS x FROM a{i}) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.t, c{i}.t) AS t FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY d) AS t FROM s{i} GROUP BY ALL) m ON m.cluster = c{i}.cluster)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.cluster AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.t, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = a{rounds}.cluster"""
