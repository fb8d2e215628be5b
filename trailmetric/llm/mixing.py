"""Mixing of sources to target weights by entropy balancing (operator 13).

1. Targets: a source's share of all words by its weight, at most ``most`` times its own words;
   the excess goes to the others by weight until no target is above. That is the level t with
   sum of min(most * words, weight * t) = all words, found from sources in the order of the
   level at which they are full.
2. Rates: of all document rates with sum(rate * size) = target those that are closest to one
   copy each in relative entropy, with ``most`` as an upper bound: rate = min(most, exp(x *
   size)). The multiplier x of each source is the root of the convex dual's derivative; every
   Newton step is one aggregation over the table of (source, size, documents), all sources
   at once, kept inside a bracket of the root.
3. Copies: from large to small sizes, a size gets the number of copies that brings the words
   taken closest to the rates' words so far, so what is left over is passed on to smaller
   documents and a source ends about half its smallest document from the target, or a small
   one where those below it are all at a bound. The copies of one size are dealt evenly, one
   more to the documents of the smallest hashes.

The text is read once; from then on rows are (id, source, size). Documents of one source and
size share a rate, so the rest works on the different sizes: a source of W words has at most
sqrt(2 W) of them, and only these come together in one task. A source and size that many
documents share is dealt to about as many parts as documents in each, the square root.

Sums of rates are added as integers (a word is 2^20), exp is the JVM's strict one, and choices
follow hashes, so runs agree whatever the partitions.

Defined results: size is the number of words ``[^\\x20\\x09-\\x0D]+``, of null, empty and blank
texts 0 and taken 0; null is a source of its own, the last; a source without words has the
target 0; rows of equal or null ids are documents of their own and which of them gets the copy
more is arbitrary if they're alike in size, too; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, remove, shared_folder, ship

WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 100  # a bracket halves at least, so this is never reached
WORD = 1 << 20


def words(text: Column) -> Column:
    """The number of words, without a list of them."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, words) with ``target``. One row a source, so windows over all of them are small."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    most_words = (F.col("words") * most).cast("double")
    # Sources in the order in which a rising level fills them; the sums before a source are of full ones.
    by_full = Window.orderBy(most_words / F.col("weight"), "place")
    before, after = by_full.rowsBetween(Window.unboundedPreceding, -1), by_full.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("words").over(whole) - F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = placed.withColumn("at", F.row_number().over(by_full)).withColumn("own", level)
    # The first source that isn't full at its level has the level of all.
    first = F.min(F.when(F.col("own") * F.col("weight") <= most_words, F.struct("at", "own"))).over(whole)
    return leveled.withColumn("level", first["own"]).withColumn("target", F.when(most_words > 0, F.least(most_words, F.col("level") * F.col("weight"))).otherwise(0.0)).select("source", "words", "target")


def exponent(x: Column) -> Column:
    """exp(x), bounded so that it doesn't overflow; far above any bound of rates."""
    return F.exp(F.least(x, F.lit(50.0)))


def rate(cell: Column, most: int) -> Column:
    """The rate of documents of the size of ``cell``: all or none where the target is at a bound."""
    open_rate = F.least(F.lit(float(most)), exponent(cell["x"] * cell["size"] / cell["mean"]))
    return F.when(cell["target"] <= 0, 0.0).when(cell["target"] >= cell["words"] * most, F.lit(float(most))).otherwise(open_rate)


def solved(cells: DataFrame, sources: DataFrame, folder: str, most: int) -> DataFrame:
    """``sources`` (key, words, docs, target) with the multiplier ``x`` of size / mean size. Tables of the steps are in ``folder``.

    cells: key, size, n.
    """
    spark = cells.sparkSession
    inside = (F.col("target") > 0) & (F.col("target") < F.col("words") * most)
    start = {"mean": F.greatest(F.col("words") / F.col("docs"), F.lit(1.0)), "x": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "open": inside}
    state = sources.withColumns(start)
    for i in range(ROUNDS):
        state.write.parquet(f"{folder}/step{i}")
        if i:
            remove(spark, f"{folder}/step{i - 1}")
        state = spark.read.schema(state.schema).parquet(f"{folder}/step{i}")
        if state.filter("open").isEmpty():
            break
        now = cells.join(state.filter("open").select("key", "x", "mean"), "key")
        tilted = exponent(F.col("x") * F.col("size") / F.col("mean"))
        taken = F.col("n") * F.col("size") * F.least(F.lit(float(most)), tilted)
        slope = F.when(tilted < most, taken * F.col("size") / F.col("mean")).otherwise(0.0)
        # Integers are added in any order alike.
        held = lambda c: F.sum((c * WORD).cast("decimal(38,0)"))
        sums = now.groupBy("key").agg(held(taken).alias("taken"), held(slope).alias("slope"))
        state = stepped(state.join(sums, "key", "left"))
    return state


def stepped(state: DataFrame) -> DataFrame:
    """A Newton step of each open source, halved into its bracket where it leaves it."""
    off = F.col("taken").cast("double") / WORD - F.col("target")
    low, high = (F.when(F.col("open") & side, F.col("x")).otherwise(F.col(c)) for c, side in (("low", off < 0), ("high", off >= 0)))
    moved = state.withColumns({"off": off, "low": low, "high": high})
    newton = F.col("x") - F.try_divide("off", F.col("slope").cast("double") / WORD)
    # Without a bound on one side, the step may be as far as the bracket can grow in one go.
    beyond = F.when(F.col("off") < 0, F.col("x") + F.greatest(F.lit(1.0), F.abs("x"))).otherwise(F.col("x") - F.greatest(F.lit(1.0), F.abs("x")))
    middle = F.when(F.col("low").isNull() | F.col("high").isNull(), beyond).otherwise((F.col("low") + F.col("high")) / 2)
    within = (newton > F.coalesce("low", F.col("x") - 2 * F.greatest(F.lit(1.0), F.abs("x")))) & (newton < F.coalesce("high", F.col("x") + 2 * F.greatest(F.lit(1.0), F.abs("x"))))
    to = F.when(newton.isNotNull() & within, newton).otherwise(middle)
    near = (F.abs("off") <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)) | (to == F.col("x"))
    return moved.withColumns({"x": F.when(F.col("open") & ~near, to).otherwise(F.col("x")), "open": F.col("open") & ~near}).drop("off", "taken", "slope")


def allotted(cells: DataFrame, most: int) -> DataFrame:
    """(key, size, n, copies) of ``cells`` (key, size, n, rate): copies of all documents of a size, left-over words passed on to smaller sizes."""

    def give(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False)
        ahead, copies = 0.0, []
        for size, n, rate in zip(part["size"].tolist(), part["n"].tolist(), part["rate"].tolist(), strict=True):
            ahead += n * size * rate
            copies.append(min(max(math.floor(ahead / size + 0.5), 0), n * most))
            ahead -= copies[-1] * size
        return part[["key", "size", "n"]].assign(copies=copies)

    # The different sizes of a source, at most sqrt(2 * its words).
    return cells.filter("size > 0").groupBy("key").applyInPandas(give, "key string, size long, n long, copies long")


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    spark = df.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/mix-{uuid.uuid4().hex}"
    # Null is no key of a join, so keys have a mark before the name, and null has none.
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    try:
        df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("key"), words(F.col(text)).alias("size")).write.parquet(f"{folder}/docs")
        docs = spark.read.parquet(f"{folder}/docs")
        docs.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/cells")
        cells = spark.read.parquet(f"{folder}/cells")
        totals = cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"))
        aims = targets(totals.select("source", "words"), weights, most).select(F.col("source").alias("s"), "target")
        sources = solved(cells.drop("source"), totals.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source"), folder, most)
        rates = cells.drop("source").join(sources.select("key", "words", "target", "mean", "x"), "key")
        rates = rates.withColumn("rate", rate(F.struct(*rates.columns), most))
        placed(docs, allotted(rates.select("key", "size", "n", "rate"), most)).write.parquet(f"{folder}/placed")
        out = dealt(spark.read.parquet(f"{folder}/placed")).join(sources.select("key", F.col("words").alias("source_size"), "target"), "key")
        return checkpointed(out.select("doc_id", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken")))
    finally:
        remove(spark, folder)


def placed(docs: DataFrame, given: DataFrame) -> DataFrame:
    """Each document with what its size gets: ``each`` copies, ``more`` documents one more; ``part`` of the documents of its size."""
    cell = ["key", "size"]
    more = given.select(*cell, F.expr("copies div n").alias("each"), F.expr("copies % n").alias("more"), F.ceil(F.sqrt("n")).alias("parts"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.coalesce("parts", F.lit(1)))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("each", "more")}
    return docs.select("doc_id", *cell).join(more, cell, "left").withColumns({"part": part, **zero}).drop("parts")


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, copies). Only where some documents of a size get one more do places count: those of the parts, then those inside a part."""
    cell = ["key", "size"]
    some = docs.filter("more > 0")
    counts = some.groupBy(*cell, "part").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*cell, "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*cell, "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    one_more = some.join(counts, [*cell, "part"]).withColumn("copies", F.col("each") + (place <= F.col("more")).cast("long"))
    even = docs.filter("more = 0").withColumn("copies", F.col("each"))
    columns = ["doc_id", *cell, "copies"]
    return one_more.select(*columns).unionByName(even.select(*columns))
