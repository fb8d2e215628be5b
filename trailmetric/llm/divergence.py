"""How far the sources of a language are from each other, by their terms (operator 11).

1. Each task counts the terms of its texts by language and source, and so sends one row for a
   term instead of one for an occurrence.
2. These counts are dealt by a hash of language and term. A shard is what one task gets: it
   sums the counts with vectorised SQL in DuckDB and keeps the terms of enough documents.
3. Spark sums the kept counts of each source. They go to the same shards again, where DuckDB
   adds, for each pair of sources, what the terms that both have contribute, and picks the
   shard's largest terms of each source.
4. A term that one of two sources lacks contributes by its count alone, so Spark adds these
   from the number of terms of each count; terms that both lack are one product. Sums of the
   shards and rankings are merged in Spark.

So the work on pairs follows the terms that sources share, a language or source of any size is
dealt by its terms, and no table goes whole through a task or the driver.  DuckDB has
``MEMORY`` and spills beyond that into the task's own scratch folder.

With p = 1 + floor(ONE * (count + 1) / (N + V)) for a term of a group, or a language, with N
occurrences of the V kept terms, the divergence of p from q is floor((p - q)^2 / q).  All of
this is in integers; sums are held in 38 digits.

Defined results: null text, language or source count as ''; a text is read whole; rows of equal
or null ids are documents of their own, so copies count; a group without terms has N = 0; in
a language without kept terms pairs have the value 0 and there are no terms; ties go to the
smaller item by its UTF-8 bytes; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ship, stored

ONE = 1_000_000_000
LEAST_DOCS = 3
TERMS = 200
MEMORY = "256MB"  # of DuckDB in one task
COUNTS_HELD = 200_000  # counts that a task holds before it sends them
SPREAD = 64  # parts in which the shards' terms are ranked before the last ranking
# Runs of letters A-Z and a-z and of all beyond ASCII; in UTF-8 the latter are the bytes from 80 on.
TERM = re.compile(rb"[a-z\x80-\xff]+")

PARTIAL = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"
FOUND = "part string, lang string, source string, item string, value decimal(38,0)"

COUNTS_SQL = """
WITH counts AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM rows GROUP BY ALL),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= {least})
SELECT lang, source, term, CAST(n AS BIGINT) AS n FROM counts SEMI JOIN whole USING (lang, term)
UNION ALL SELECT lang, NULL, term, CAST(n AS BIGINT) FROM whole
"""
PLACED_SQL = """
CREATE TABLE placed AS
SELECT lang, source, term, CAST(1 + CAST({one} AS HUGEINT) * (n + 1) // (total + kept) AS BIGINT) AS p, CAST(1 + {one} // (total + kept) AS BIGINT) AS none
FROM rows
"""
PAIRS_SQL = """
SELECT 'pair' AS part, a.lang AS lang, a.source AS source, b.source AS item,
       CAST(sum(f(a.p, b.p) - f(a.p, b.none) - f(a.none, b.p) + f(a.none, b.none)) AS DECIMAL(38, 0)) AS value
FROM placed a JOIN placed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
TERMS_SQL = """
SELECT 'term' AS part, a.lang AS lang, a.source AS source, a.term AS item, CAST(f(a.p, b.p) AS DECIMAL(38, 0)) AS value
FROM placed a JOIN placed b ON a.lang = b.lang AND a.term = b.term AND a.source IS NOT NULL AND b.source IS NULL WHERE a.p > b.p
QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY value DESC, item) <= {terms}
"""


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts of each task, several rows a term where it has sent them meanwhile."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [t.decode("utf-8", "replace") for t in n]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(([lang] * len(n), [source] * len(n), terms, n.values(), [docs[t] for t in n]), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                words = TERM.findall(text.as_py().lower())
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > COUNTS_HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    return docs.mapInArrow(run, PARTIAL)


@contextmanager
def database(rows: pa.RecordBatchReader) -> Iterator[duckdb.DuckDBPyConnection]:
    """DuckDB with the reader's rows as ``rows``, to be read once; what it spills goes with the task."""
    with tempfile.TemporaryDirectory(prefix="shard-") as scratch:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch})
        try:
            con.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // q")
            con.register("rows", rows)
            yield con
        finally:
            con.close()


def in_shards(df: DataFrame, statements: list[str], results: list[str], schema: str) -> DataFrame:
    """Runs the SQL over ``rows``, which are those of one shard, and gives the rows of all results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with database(pa.RecordBatchReader.from_batches(first.schema, again())) as con:
            for s in statements:
                con.execute(s)
            for q in results:
                yield from con.sql(q).to_arrow_reader(16_384)

    return df.repartition("lang", "term").mapInArrow(run, schema)


def probability(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(ONE * (n + 1) / (total + kept)); the product may be beyond 64 bits."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.lit(1) + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 1).cast("decimal(20,0)"), F.col(total) + F.col(kept))).cast("long")


def distance(p: str, q: str) -> Column:
    return F.expr(f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))")


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """With ``rank`` in each group and part. ``most``: ranks to this, and of each of SPREAD parts of a group no more rows than this come together."""
    keys, order = ["lang", "source", "part"], [F.desc("value"), F.col("item")]
    if most is not None:
        by = Window.partitionBy(*keys, F.pmod(F.xxhash64("item"), F.lit(SPREAD))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).drop("rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows if most is None else rows.filter(F.col("rank") <= most)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from the others of its language, and its terms that are far above the language's."""
    ship(df.sparkSession)
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(own(lang).alias("lang"), own(source).alias("source"), own(text).alias("text"))
    # The result is written before these two tables go.
    with stored(in_shards(term_counts(docs), [], [COUNTS_SQL.format(least=least_docs)], KEPT)) as kept:
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
        languages = sums.filter("source is null").select("lang", F.col("total").alias("lang_total"), F.col("terms").alias("kept"))
        whole = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        with stored(whole.select("lang", "source", *map(zero, ("total", "terms", "kept", "lang_total")))) as groups:
            return _merged(kept, groups, languages, terms)


def _merged(kept: DataFrame, groups: DataFrame, languages: DataFrame, terms: int) -> DataFrame:
    totals = groups.select("lang", "source", "total", "kept").unionByName(languages.select("lang", F.lit(None).cast("string").alias("source"), F.col("lang_total").alias("total"), "kept"))
    mine = totals.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "kept")
    rows = kept.join(mine, (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    found = in_shards(rows, [PLACED_SQL.format(one=ONE)], [PAIRS_SQL, TERMS_SQL.format(terms=terms)], FOUND)
    with stored(found) as found:
        none = probability(F.lit(0), "total", "kept")
        usable = groups.filter("kept > 0").withColumn("none", none)
        other = usable.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("terms").alias("other_terms"))
        # Terms of one source alone, by how many of its terms have a count: this source is p of one pair and q of another.
        spread = kept.filter("source is not null").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
        alone = spread.withColumn("p", probability("n", "total", "kept")).join(other, "lang").filter("source <> item")
        each = F.explode(F.array(*[F.struct(a.alias("source"), b.alias("item"), (F.col("m") * v).cast("decimal(38,0)").alias("value")) for a, b, v in ((F.col("source"), F.col("item"), distance("p", "other_none")), (F.col("item"), F.col("source"), distance("other_none", "p")))]))
        one = alone.select("lang", each.alias("e")).select("lang", "e.source", "e.item", "e.value")
        # Terms of neither: all kept ones less those of either; what both have is added to these again by the shards.
        lacking = usable.join(other, "lang").filter("source <> item")
        neither = lacking.select("lang", "source", "item", ((F.col("kept") - F.col("terms") - F.col("other_terms")) * distance("none", "other_none")).cast("decimal(38,0)").alias("value"))
        names = groups.select("lang", F.col("source").alias("item"))
        nothing = groups.filter("kept = 0").join(names, "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
        both = found.filter("part = 'pair'").drop("part")
        pairs = both.unionByName(one).unionByName(neither).unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = ranked(pairs.withColumn("part", F.lit("pair")))
        top = ranked(found.filter("part = 'term'"), terms)
        return checkpointed(pairs.unionByName(top).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"))


#: All of it in one engine, with every source's value of every kept term.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + z.v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (z.total + z.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes z USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
