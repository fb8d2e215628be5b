"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, divergence, exact_dedup, licenses, mixing, near_dedup, packing, pii, quality, token_counts, topk, toxicity
from .common import strict, table

# Files of the driver; the operators send them to the executors.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict(table(spark, sf_dir, "documents"), "doc_id", "text")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS s
  FROM w),
s AS (SELECT doc_id, unnest(s) AS h FROM g),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN g x ON a = x.doc_id JOIN g y ON b = y.doc_id WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN c ON g.doc_id = c.doc_id
"""


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(documents(spark, sf_dir), BYTE_BPE, carry=["doc_id"])
    back = bpe.decode(ids, BYTE_BPE)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM t WINDOW w AS (PARTITION BY sha ORDER BY size DESC, doc_id)
"""


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row's label is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(4, 2)
    labels = strict(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(~out)
    scored = quality.score(docs, quality.train(docs, labels), carry=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: F.startswith(s, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.array_join("base", ","), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, pii.KINDS), digest, F.array_join(F.concat("base", "terms"), ",").alias("spans"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, BYTE_BPE, tokens=1024)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = strict(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
terms AS (SELECT vec_id, unnest(range(len(t))) AS d, unnest(t) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(5, 0)
    labels = strict(table(spark, sf_dir, "labels"), "doc_id", "toxic").filter(~out)
    scored = toxicity.score(docs, toxicity.train(docs, labels), carry=["doc_id"])
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("offending"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), WORD_BPE, carry=["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(strict(table(spark, sf_dir, "documents"), "text", "lang", "source"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(strict(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), k=40, rounds=5, seed=2, dims=64)


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(strict(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), weights=(5, 2, 1), most=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_top_k": op7_top_k,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_divergence": op11_divergence,
    "op12_clusters": op12_clusters,
    "op13_mixture": op13_mixture,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_pii": pii.sql(),
    "op7_top_k": OP7_SQL,
    "op8_license_scan": licenses.sql(),
    "op11_divergence": divergence.SQL,
    "op12_clusters": clusters.sql(),
}
