"""Exact top-k search by block-at-a-time pruning (operator 7).

Candidates stand in cells (alike vectors, by the nearest of a bounded number of centroids),
cells in shares of bounded size, shares in blocks (ranges of the share's list).  Cells and
blocks hold their terms' extreme values; a block also has a forward index (its rows' terms).
For a query a cell's or block's bound is the sum of the terms' best contributions, which no
score inside exceeds.

1. A query first searches the cells of its largest bounds that hold k rows. This gives it a
   k-th score, a threshold that every share knows from then on.
2. It then goes to those other cells alone whose bound reaches its threshold.
3. In a share, blocks are scored in the order of their bounds and the k-th score is renewed
   between goes, which double, until no bound reaches it; equal bounds are scored, as they
   may hold a tie with a smaller id.  Only rows that reach the threshold leave the share.
4. A ranking merges what the shares found.

Queries of equal vectors are searched once, for one row more than asked, as each leaves out
its own id.  A cell of many rows is dealt to several shares by a hash of the id, its queries
to several lots, so shares are bounded whatever the cell; nothing is sent to a cell that no
query goes to.  Centroids are fitted to at most ``SAMPLE_ROWS`` vectors (the first by a hash
of their ids); they decide how well bounds prune, never the result.

Scores are integers: components become floor(scale * x).  They are added in double precision
where this is exact and as Python integers where not; components and scores beyond 64 bits
count as the largest or smallest 64-bit integer.

Defined results: vectors that are null, empty, or hold a null or non-finite component take
no part, neither do rows without an id; only vectors of equal length are compared; ties go
to the smaller id; a query never finds rows with its own id; rows alike in id and vector
count once; vectors of any length are read whole; an empty table gives no rows; of the
caller's columns only id and vector are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, ship

SAMPLE_ROWS = 16_384
CELL_SAMPLE = 128  # sampled rows to a centroid, so at most SAMPLE_ROWS / CELL_SAMPLE cells
SHARE_ROWS = 65_536
LOT_ROWS = 32_768
BLOCK_ROWS = 16
SCORES_AT_ONCE = 1 << 22
EXACT = 1 << 53
LONG = (1 << 63) - 1


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, terms array<long>) of the rows that take part."""
    terms = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = ~F.exists(terms, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(vec_id).isNotNull() & (F.size(vector) > 0) & whole
    return df.filter(usable).select(F.col(vec_id).alias("vec_id"), F.transform(terms, lambda x: F.floor(x * scale)).alias("terms"))


def _bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(queries, ranges): what no score in a range exceeds."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def _exact(size: int, q: np.ndarray) -> bool:
    """Whether doubles hold all sums of products with terms of up to ``size``."""
    return size * int(np.abs(q.astype(object)).max(initial=0)) * max(q.shape[1], 1) < EXACT


class BlockIndex:
    """Blocks of one share's rows, all of one length."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, rows: int = BLOCK_ROWS):
        order = cluster(terms, rows)
        self.ids, self.terms = ids[order], terms[order]
        cuts = np.arange(0, len(ids), rows)
        self.cuts = np.append(cuts, len(ids))
        self.most, self.least = np.maximum.reduceat(self.terms, cuts, axis=0), np.minimum.reduceat(self.terms, cuts, axis=0)
        self.size = int(np.abs(self.terms.astype(object)).max(initial=0))

    def search(self, query_ids, queries: np.ndarray, k: int, floors=None) -> Iterator[tuple]:
        """(query id, row id, score): the k best rows of each query of at least its floor, ties to smaller ids."""
        kind = np.float64 if _exact(self.size, queries) else object
        q, forward, most, least = (x.astype(kind) for x in (queries, self.terms, self.most, self.least))
        floors = np.full(len(q), -np.inf) if floors is None else floors
        step = max(1, SCORES_AT_ONCE // len(self.ids))
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            yield from self._search_some(query_ids[part], q[part], forward, _bounds(q[part], most, least), k, floors[part].astype(kind))

    def _search_some(self, query_ids, q, forward, bounds, k, kth) -> Iterator[tuple]:
        big = q.dtype == object
        held = (lambda x: np.clip(x, -LONG - 1, LONG)) if big else (lambda x: x)
        bounds = held(bounds)
        order = np.argsort(-bounds, axis=1, kind="stable")
        scores = np.full((len(q), len(self.ids)), -np.inf, dtype=q.dtype)
        low, high = 0, 1
        while low < order.shape[1]:
            blocks = order[:, low:high]
            asking, place = np.nonzero(np.take_along_axis(bounds, blocks, axis=1) >= kth[:, None])
            if not len(asking):
                break  # bounds fall along the order, so no later one reaches the k-th score
            at = blocks[asking, place]
            by = np.argsort(at, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                rows = slice(self.cuts[at[own[0]]], self.cuts[at[own[0]] + 1])
                scores[asking[own], rows] = held(q[asking[own]] @ forward[rows].T)
            if len(self.ids) >= k:
                found = np.sort(scores, axis=1) if big else np.partition(scores, -k, axis=1)
                kth = np.maximum(kth, found[:, -k])
            low, high = high, high * 2
        for me, row, least in zip(query_ids, scores, kth):
            hits = np.flatnonzero((row >= least) & (row != -np.inf))
            for h in hits[np.lexsort((self.ids[hits], -row[hits]))[:k]]:
                yield me, self.ids[h], int(row[h])


def cluster(terms: np.ndarray, rows: int) -> np.ndarray:
    """An order in which runs of ``rows`` are alike: halves by the direction of largest spread, again and again."""
    parts, done = [np.arange(len(terms))], []
    while parts:
        part = parts.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        x = terms[part].astype(np.float64)
        x -= x.mean(axis=0)
        axis = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(4):
            axis = x.T @ (x @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        cut = max(rows, len(part) // 2 // rows * rows)
        halves = np.argsort(x @ axis, kind="stable")
        parts += [part[halves[cut:]], part[halves[:cut]]]
    return np.concatenate(done) if done else np.empty(0, np.int64)


class Cells:
    """Centroids by the vectors' length; a length that the sample lacks has one cell. Cells have numbers of their own across lengths."""

    def __init__(self, sample: list[list[int]]):
        lengths: dict[int, list] = {}
        for terms in sample:
            lengths.setdefault(len(terms), []).append(terms)
        self.centroids: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        self.n = 1  # cell 0: lengths that the sample lacks
        for dims, rows in sorted(lengths.items()):
            x = np.array(rows, dtype=np.float64)
            order = cluster(x, CELL_SAMPLE)
            self.centroids[dims] = np.stack([x[order[at : at + CELL_SAMPLE]].mean(axis=0) for at in range(0, len(x), CELL_SAMPLE)])
            self.first[dims], self.n = self.n, self.n + len(self.centroids[dims])

    def of(self, terms: np.ndarray) -> np.ndarray:
        """The cells of rows of one length."""
        if (c := self.centroids.get(terms.shape[1])) is None:
            return np.zeros(len(terms), dtype=np.int64)
        x = terms.astype(np.float64)
        return self.first[terms.shape[1]] + np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in frame.groupby(frame["terms"].map(len), sort=True):
        yield part, np.stack(part["terms"].to_list())


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` (vec_id, terms) with their length and cell."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most SAMPLE_ROWS / CELL_SAMPLE centroids a length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, terms in _by_length(frame):
                yield part.assign(dims=np.int32(terms.shape[1]), cell=shared.value.of(terms).astype("int32"))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("dims", T.IntegerType()), T.StructField("cell", T.IntegerType())]))


def extremes(rows: DataFrame) -> DataFrame:
    """cell, dims, n, most and least (terms' extremes) of the cells: one row a task and cell, merged by cell."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cell", "dims")] + [T.StructField("n", T.LongType()), T.StructField("most", longs), T.StructField("least", longs)])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        most, least = np.stack(frame["most"].to_list()).max(axis=0), np.stack(frame["least"].to_list()).min(axis=0)
        return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "dims": [frame["dims"].iloc[0]], "n": [frame["n"].sum()], "most": [most], "least": [least]})

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, pd.DataFrame] = {}
        for frame in frames:
            for key, part in frame.groupby(["cell", "dims"], sort=False):
                terms = np.stack(part["terms"].to_list())
                one = pd.DataFrame({"cell": [key[0]], "dims": [key[1]], "n": [len(part)], "most": [terms.max(axis=0)], "least": [terms.min(axis=0)]})
                held[key] = merged(pd.concat([held[key], one])) if key in held else one
        yield from held.values()

    return rows.mapInPandas(partial, schema).groupBy("cell", "dims").applyInPandas(merged, schema)


def routed(queries: DataFrame, known: list, k: int) -> DataFrame:
    """(vec_id, terms, dims, cell, bound, first): queries by the cells of their length; ``first`` are those of the largest bounds that hold k rows."""
    lengths: dict[int, list] = {}
    for r in known:
        lengths.setdefault(r.dims, []).append(r)
    shared = queries.sparkSession.sparkContext.broadcast(  # one row of extremes a cell
        {dims: (np.array([r.cell for r in rows]), np.array([r.n for r in rows]), np.array([r.most for r in rows]), np.array([r.least for r in rows])) for dims, rows in lengths.items()}
    )
    kinds = [("dims", T.IntegerType()), ("cells", T.ArrayType(T.IntegerType())), ("bounds", T.ArrayType(T.DoubleType())), ("firsts", T.ArrayType(T.BooleanType()))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, q in _by_length(frame):
                cell, n, most, least = shared.value[q.shape[1]]
                big = int(np.abs(np.stack([most, least]).astype(object)).max(initial=0))
                kind = np.float64 if _exact(big, q) else object
                bounds = _bounds(*(x.astype(kind) for x in (q, most, least)))
                # A double above the bound where it is rounded.
                bounds = bounds if kind is np.float64 else np.nextafter(np.clip(bounds, -LONG - 1, LONG).astype(np.float64), np.inf)
                order = np.argsort(-bounds, axis=1, kind="stable")
                sums = np.cumsum(n[order], axis=1)
                first = sums - n[order] < k
                yield part.assign(dims=np.int32(q.shape[1]), cells=list(cell[order].astype("int32")), bounds=list(np.take_along_axis(bounds, order, axis=1)), firsts=list(first))

    ranked = queries.mapInPandas(run, T.StructType([*queries.schema.fields, *[T.StructField(c, kind) for c, kind in kinds]]))
    each = ranked.select("vec_id", "terms", "dims", F.explode(F.arrays_zip("cells", "bounds", "firsts")).alias("c"))
    return each.select("vec_id", "terms", "dims", F.col("c.cells").alias("cell"), F.col("c.bounds").alias("bound"), F.col("c.firsts").alias("first"))


def searched(rows: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best rows that each share finds for the queries ``asked`` (vec_id, terms, dims, cell, floor) of its cell."""
    counts = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    top = max([*sizes, 0]) + 1
    per = lambda counted, most: F.element_at(F.array(*[F.lit(-(-counted.get(c, 0) // most)) for c in range(top)]), F.col("cell") + 1)
    shares, lots = F.greatest(per(sizes, SHARE_ROWS), F.lit(1)), per(counts, LOT_ROWS)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    left = rows.filter(lots > 0).select("vec_id", "terms", "dims", "cell", deal(shares).alias("share"), each(lots).alias("lot"))
    right = asked.select("vec_id", "terms", "dims", "cell", "floor", each(shares).alias("share"), deal(lots).alias("lot"))
    id_type = rows.schema["vec_id"].dataType
    found = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])

    def share(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(queries):
            if docs["vec_id"].duplicated().any():
                docs = docs[~pd.DataFrame({"i": docs["vec_id"], "t": docs["terms"].map(bytes)}).duplicated()]
            index = BlockIndex(docs["vec_id"].to_numpy(), np.stack(docs["terms"].to_list()))
            # A double below the floor, as not every integer is one.
            floors = np.nextafter(queries["floor"].astype("float64").fillna(-np.inf).to_numpy(), -np.inf)
            out = list(index.search(queries["vec_id"].to_numpy(), np.stack(queries["terms"].to_list()), k, floors))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ["cell", "dims", "share", "lot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(share, found)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``rank`` 1..k of each query's rows, cut to k in each task before they move."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best rows."""
    ship(df.sparkSession)
    rows = quantised(df, vec_id, vector, scale)
    own = quantised(df.filter(is_query), vec_id, vector, scale).distinct()
    # Queries of equal vectors are one search, named by the smallest of them.
    classes = own.groupBy("terms").agg(F.min("vec_id").alias("vec_id"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("terms").collect()
    rows = checkpointed(placed(rows, Cells([r.terms for r in sample])))
    known = extremes(rows).collect()  # one row a cell
    sizes = {r.cell: r.n for r in known}
    more = k + 1  # a query's own row may be among them
    routes = checkpointed(routed(classes.select("vec_id", "terms"), known, more)) if known else None
    if routes is None:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    first = checkpointed(ranked(searched(rows, routes.filter("first").withColumn("floor", F.lit(None).cast("long")), sizes, more), more))
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == more, F.min("score")).alias("floor"))
    rest = routes.filter("not first").join(floors, F.col("vec_id") == F.col("id"), "left").filter("floor is null or bound >= floor")
    found = first.drop("rank").unionByName(searched(rows, checkpointed(rest.drop("id")), sizes, more))
    best = ranked(found, more).select(F.col("query_id").alias("class_id"), F.col("vec_id").alias("found_id"), "score")
    mine = own.join(classes.select("terms", F.col("vec_id").alias("class_id")), "terms").select(F.col("vec_id").alias("query_id"), "class_id")
    others = mine.join(best, "class_id").filter("query_id <> found_id").select("query_id", F.col("found_id").alias("vec_id"), "score").distinct()
    return ranked(others, k).select("query_id", "rank", "vec_id", "score")
