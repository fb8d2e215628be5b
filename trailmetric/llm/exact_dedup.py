"""Exact dedup by a 128-bit content hash, with a byte comparison inside its groups (operator 3).

1. Every row becomes (hash of the normalised text, id, length); groups are counted by the hash
   alone, so no text moves.
2. Texts are fetched for hashes of two rows or more and compared as bytes: an aggregation by
   (hash, text) sends each different text once a task, however many copies there are.
3. A hash with several texts is a collision; its texts are numbered, and their rows carry the
   number beside the hash. Rows of all other hashes carry 0.
4. Each (hash, number) keeps the id of the longest original text, the smallest of equals, by
   counts and minima that are combined before the shuffle. The result goes back to the rows by
   another key than the aggregation's, so the rows of a large group can be split.

Defined results: null texts count as empty; empty texts are equal to each other; of equal
lengths the smallest id stays, a null id only if no other is as long; texts of any length are
compared whole; rows that repeat an id each count, and each has ``kept`` if the id stays
(``deduplicate`` keeps one of them, whatever its id); an empty table gives no rows; of the
caller's columns only id and text are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, repeated, stored, unused, without

BLANKS = r"[\x20\x09-\x0D]+"


def without_blanks(text: Column) -> Column:
    """The text without blanks, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(norm: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(norm, 256), 1, 32))


def hashed(df: DataFrame, doc_id: str, text: str, normalise, hash128) -> DataFrame:
    """doc_id, norm, size (of the original text) and hash of every row."""
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("norm"), size.alias("size"))
    return rows.withColumn("hash", hash128(F.col("norm")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``variant``: the number of the row's text among those of its hash, 0 unless texts collide."""
    many = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    with stored(many) as held:
        # The planner knows the size of a stored table: hashes are broadcast if they are few, or thin out the scan as a filter.
        texts = rows.select("hash", "norm").join(held, "hash", "left_semi").groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("n"))
        collisions = checkpointed(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"))
    if collisions.isEmpty():
        return rows.withColumn("variant", F.lit(0))
    apart = rows.select("hash", "norm").join(collisions, "hash", "left_semi").distinct()
    apart = apart.withColumn("variant", F.row_number().over(Window.partitionBy("hash").orderBy("norm")))
    return rows.join(apart, ["hash", "norm"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=without_blanks, hash128=content_hash, digest=lambda norm: F.sha2(norm, 256)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (``digest`` of the normalised text) of every row of ``df``."""
    rows = numbered(hashed(df, doc_id, text, normalise, hash128))
    # One row for each group and original length, then one for each group.
    lengths = rows.groupBy("hash", "variant", "size").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    found = lengths.groupBy("hash", "variant").agg(F.max_by("first_id", "size").alias("keep_id"), F.sum("n").alias("group_size"))
    # Another key than the aggregation's, so the join deals its rows anew and can split a large group's.
    key = F.concat_ws(":", F.hex("hash"), "variant").alias("key")
    return (
        rows.select("doc_id", key, digest(F.col("norm")).alias("text_sha256"))
        .join(found.select(key, "keep_id", "group_size"), "key")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns of ``df``; of rows alike in id and text, an arbitrary one."""
    found = groups(df, doc_id, text)
    again = repeated(df, doc_id)
    if again.isEmpty():
        return without(df, found.filter(~F.col("kept")), doc_id)
    sha, stay_id, stay_sha = (unused(df, c) for c in ("own_sha", "stay_id", "stay_sha"))
    stay = found.filter("kept").select(F.col("keep_id").alias(stay_id), F.col("text_sha256").alias(stay_sha)).distinct()
    rows = df.withColumn(sha, F.sha2(without_blanks(F.col(text)), 256)).dropDuplicates([doc_id, sha])
    return rows.join(stay, F.col(doc_id).eqNullSafe(F.col(stay_id)) & (F.col(sha) == F.col(stay_sha)), "left_semi").select(*df.columns)
