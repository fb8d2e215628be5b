"""PII by patterns and information-theoretic sanitisation (operator 5), DataFrame functions only.

Protected entities are the values that fixed patterns find: e-mail and IP addresses, card
and phone numbers.  What stands in the same document may reveal them too.  For a term t in
a document with an entity e, with counts d of different texts over the D of the corpus,

    PMI(t; e) = log2(d(t, e) * D / (d(t) * d(e))),    IC(e) = log2(D / d(e)),

PMI / IC is how much of the entity's information the term gives away: 1 if the term is
never seen without it.  Terms at or above ``GENERALISE`` become their kind, those at or above
``REMOVE`` go, wherever they stand in a document with that entity.  Copies are no evidence:
equal texts count once, and the texts that a term shares with an entity must have ``SUPPORT``
different windows, which near copies have in common.  A window is the ``WINDOW`` words on either
side of the entity, up to the entity next to it.

The scan of the texts is one narrow pass that keeps the texts with entities; the terms of an
entity without enough windows are not counted, as none of them could have enough, and where no
term is left the corpus is not counted at all.  Corpus words are dropped before they move unless
some entity's windows ask for them.

Defined results: null texts count as empty and stay null; an entity is its value in lower
case (digits only for numbers); spans count code points, end exclusive; a span inside an
earlier one is listed but replaced with it; a term that two entities of a text disclose counts
by the larger share; rows that repeat an id, or have none, are told apart by their texts, and
repeated rows each have their result; long texts are searched whole, in linear time but for
the list of a text's own spans, which grows by copies; an empty table gives no rows; the
caller's columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 3  # words on either side
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95

# The contract's patterns, with possessive parts and starts that no earlier start could
# have matched from: the same matches, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda x, i: x.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_VALID_IP)
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)


def _possible(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def found(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, value>> of a kind's valid matches: leftmost, not overlapping."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int, value: string>>)")
    zipped = F.zip_with(gaps, values, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    placed = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(_possible(kind, text), placed).otherwise(none)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``pii_text`` (null as empty) and ``pii_base``: the kinds' spans, in the order of ``KINDS``."""
    df = df.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("pii_base", F.concat(*[found(kind, F.col("pii_text")) for kind in KINDS]))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _words(window: Column) -> Column:
    """Words of a stretch of text, with the blanks before each: array<struct<gap, word>> by pairs of lengths and words."""
    words = F.regexp_extract_all(window, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    gaps = F.split(window, r"[\p{L}\p{N}]+", -1)
    return F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")))


def occurrences(base: DataFrame, doc_id: str) -> DataFrame:
    """The rows with entities: doc, version (of the text), pii_text, pii_base and entities: array<struct<entity, window (the words around)>>."""
    text, spans = F.col("pii_text"), F.col("pii_spans")
    words = lambda stretch: F.regexp_extract_all(F.lower(stretch), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def around(s: Column, i: Column) -> Column:
        low, high = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), F.coalesce(F.get(spans, i + 1)["start"], F.length(text))
        before = words(F.substring(text, low + 1, F.greatest(s["start"] - low, F.lit(0))))
        after = words(F.substring(text, s["end"] + 1, F.greatest(high - s["end"], F.lit(0))))
        near = F.slice(F.reverse(before), 1, WINDOW)
        return F.concat_ws(" ", F.reverse(near), F.lit("|"), F.slice(after, 1, WINDOW))

    entities = F.transform(spans, lambda s, i: F.struct(_entity(s).alias("entity"), around(s, i).alias("window")))
    by_start = F.array_sort(F.transform("pii_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    held = base.filter(F.size("pii_base") > 0).withColumn("pii_spans", by_start)
    return held.select(F.col(doc_id).alias("doc"), F.xxhash64("pii_text").alias("version"), "pii_text", "pii_base", entities.alias("entities"))


def _blanked(spans: Column) -> Column:
    """The spans, in order, to be replaced by a blank: what is left are words outside entities."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("label"))))


def disclosing(df: DataFrame, each: DataFrame, one: DataFrame, text: str) -> DataFrame | None:
    """(entity, term, disclosure) of the terms that give away at least ``GENERALISE`` of an entity, None if no term has enough windows.

    ``one`` has one row of each different text with entities, ``each`` a row for each of these and each entity in it.
    """
    enough = F.count_distinct("window") >= SUPPORT
    able = each.groupBy("entity").agg(F.count(F.lit(1)).alias("d_e"), enough.alias("_enough")).filter("_enough").drop("_enough")
    able = checkpointed(each.join(able, "entity"))
    inside = F.regexp_extract_all(F.lower(_replaced(F.col("pii_text"), _blanked(F.col("pii_base")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = one.join(able.select("version").distinct(), "version", "left_semi").select("version", F.explode(F.array_distinct(inside)).alias("term"))
    together = words.join(able, "version").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("d_te"), F.max("d_e").alias("d_e"), enough.alias("_enough")).filter("_enough").drop("_enough")
    together = checkpointed(together)
    if together.isEmpty():
        return None
    held = F.coalesce(F.col(text), F.lit(""))
    copies = checkpointed(df.groupBy(F.xxhash64(held).alias("version")).agg(F.count(F.lit(1)).alias("n")))
    total = copies.count()
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(held), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term")
    with stored(together.select("term").distinct()) as wanted, stored(copies.filter("n > 1").select(F.col("version").alias("again"), "n")) as repeated:
        # Rows are counted by term alone, which tasks combine before they send anything; what copies add is taken off again.
        rows = df.select(said).groupBy("term").agg(F.count(F.lit(1)).alias("rows")).join(wanted, "term", "left_semi")
        texts = df.select(F.xxhash64(held).alias("version"), F.col(text)).join(repeated.select("again"), F.col("version") == F.col("again"), "left_semi")
        pairs = texts.select("version", said).join(wanted, "term", "left_semi").distinct().join(repeated, F.col("version") == F.col("again"))
        extra = pairs.groupBy("term").agg(F.sum(F.col("n") - 1).alias("extra"))
        terms = checkpointed(rows.join(extra, "term", "left").select("term", (F.col("rows") - F.coalesce("extra", F.lit(0))).alias("d_t")))
    both = together.join(terms, "term")
    pmi = F.log2(F.col("d_te") * F.lit(float(total)) / (F.col("d_t") * F.col("d_e")))
    content = F.log2(F.lit(float(total)) / F.col("d_e"))
    both = both.filter(F.col("d_e") < total).withColumn("disclosure", F.least(pmi / content, F.lit(1.0)))
    return checkpointed(both.filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"))


def _places(text: Column, blanked: Column, terms: Column) -> Column:
    """array<struct<start, end, disclosure>> of the words that ``terms`` (a map) has, outside the spans ``blanked``: one fold, linear in the words."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, disclosure: double>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["word"])
        of = F.element_at(terms, F.lower(x["word"]))
        hit = of.isNotNull() & ~F.exists(blanked, lambda s: (start < s["end"]) & (end > s["start"]))
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), of.alias("disclosure"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_words(text), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def term_spans(df: DataFrame, base: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """doc, version (of the text) and terms: array<struct<start, end, disclosure>> in order, each place once; None if nothing is disclosed."""
    near = checkpointed(occurrences(base, doc_id))  # the texts are searched once; only those with entities are kept
    one = near.dropDuplicates(["version"])
    each = one.select("version", F.explode("entities").alias("e")).groupBy("version", "e.entity").agg(F.min("e.window").alias("window"))
    each = checkpointed(each)
    found = disclosing(df, each, one, text)
    if found is None or found.isEmpty():
        return None
    hits = each.join(found, "entity").groupBy("version", "term").agg(F.max("disclosure").alias("disclosure"))
    hits = hits.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("of"))
    # A row of each text is searched for the places, and rows of the same text have the same.
    placed = one.join(hits, "version").select("version", _places(F.col("pii_text"), F.col("pii_base"), F.col("of")).alias("terms"))
    return near.select("doc", "version").distinct().join(placed, "version")


def _listed(span: Column, kind: Column) -> Column:
    return F.concat_ws(":", kind, span["start"], span["end"])


def _with_terms(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, at: the text's version) with the places of their terms, none where there are none."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, disclosure: double>>)")
    if terms is None:
        return rows.withColumn("terms", none)
    joined = rows.join(terms, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("at") == F.col("version")), "left")
    return joined.withColumn("terms", F.coalesce("terms", none))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of kind:start:end by kind, then start) and terms (likewise) of every row."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The patterns run once; of texts only those with entities are kept.
    scanned = with_base(own, "text").select("doc_id", F.xxhash64("pii_text").alias("at"), "pii_base", F.when(F.size("pii_base") > 0, F.col("pii_text")).alias("pii_text"))
    scanned = checkpointed(scanned)
    rows = _with_terms(scanned.drop("pii_text"), term_spans(own, scanned, "doc_id", "text"))
    base = F.transform("pii_base", lambda s: _listed(s, s["kind"]))
    return rows.select("doc_id", base.alias("base"), F.transform("terms", lambda s: _listed(s, F.lit(TERM))).alias("terms"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, label) replaced; one that begins inside an earlier one goes with it."""

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), s["label"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(kept).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its columns, entities replaced by their kind in brackets and disclosing terms generalised or removed."""
    # The caller's row stays in one column, so its names can't clash with those in use here.
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Only a text with a digit or an @ can hold an entity.
    suspect = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    base = with_base(held.filter(suspect), "text")
    rows = _with_terms(base.withColumn("at", F.xxhash64("pii_text")), term_spans(held.select("doc_id", "text"), base, "doc_id", "text"))
    kinds = F.transform("pii_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    label = lambda s: F.when(s["disclosure"] >= REMOVE, "").otherwise("[TERM]")
    own = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    rows = rows.withColumn("spans", F.array_sort(F.concat(kinds, own)))
    clean = F.when(F.size("spans") > 0, _replaced(F.col("pii_text"), F.col("spans"))).otherwise(F.col("text"))
    rows = rows.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns])
    return df.filter(~F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))).unionByName(rows)


def sql() -> str:
    """The query op5 over table ``documents``, for DuckDB: the patterns as given, texts told apart by themselves."""
    patterns = {  # fixed values: the contract's patterns
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: (CAST(reverse({digits})[i + 1] AS INT) * (1 + i % 2)) - CASE WHEN CAST(reverse({digits})[i + 1] AS INT) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS BIGINT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }

    def places(source: str, pattern: str, more: str = "") -> str:
        """r, s, e, v of all matches: gaps and matches are laid end to end."""
        return f"""SELECT r{more}, CAST(sum(length(g) + length(v)) OVER w - length(v) AS BIGINT) AS s, CAST(sum(length(g) + length(v)) OVER w AS BIGINT) AS e, v FROM (
          SELECT r, unnest(range(len(m))) AS i, unnest(string_split_regex(text, '{pattern}')[1:len(m)]) AS g, unnest(m) AS v FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS m FROM {source}))
          WINDOW w AS (PARTITION BY r ORDER BY i)"""

    spans = " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, s, e, v FROM ({places('texts', pattern)}) WHERE {valid[kind]}" for k, (kind, pattern) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in patterns)
    word = r"[\p{L}\p{N}]+"
    near = lambda stretch, order: f"array_to_string(list_reverse(list_reverse(regexp_extract_all(lower({stretch}), '{word}'))[1:{WINDOW}]), ' ')" if order else f"array_to_string(regexp_extract_all(lower({stretch}), '{word}')[1:{WINDOW}], ' ')"
    return f"""WITH own AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
    texts AS (SELECT min(d) AS r, text FROM own GROUP BY text),
    spans AS ({spans}),
    base AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS base FROM spans GROUP BY r),
    placed AS (SELECT *, coalesce(lag(e) OVER w, 0) AS low, lead(s) OVER w AS high FROM spans WINDOW w AS (PARTITION BY r ORDER BY s, e, kind, v)),
    each AS (SELECT r, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits} ELSE lower(v) END AS entity,
      min(concat_ws(' ', nullif({near("text[low + 1:s]", True)}, ''), '|', nullif({near("text[e + 1:coalesce(high, length(text))]", False)}, ''))) AS win FROM placed JOIN texts USING (r) GROUP BY ALL),
    able AS (SELECT entity, count(*) AS d_e FROM each GROUP BY entity HAVING count(DISTINCT win) >= {SUPPORT}),
    words AS (SELECT r, s, e, lower(v) AS term FROM ({places('texts', word)})),
    free AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = w.r AND w.s < b.e AND w.e > b.s)),
    together AS (SELECT entity, term, count(*) AS d_te FROM (SELECT DISTINCT r, term FROM free) JOIN each USING (r) JOIN able USING (entity) GROUP BY ALL HAVING count(DISTINCT win) >= {SUPPORT}),
    total AS (SELECT count(*) AS n FROM texts), terms AS (SELECT term, count(DISTINCT r) AS d_t FROM words GROUP BY term),
    shares AS (SELECT entity, term, least(log2(CAST(d_te AS DOUBLE) * n / (d_t * d_e)) / log2(CAST(n AS DOUBLE) / d_e), 1.0) AS disclosure FROM together JOIN terms USING (term) JOIN able USING (entity), total WHERE d_e < n),
    hits AS (SELECT DISTINCT f.r, s, e FROM free f JOIN each USING (r) JOIN shares h ON h.entity = each.entity AND h.term = f.term WHERE disclosure >= {GENERALISE}),
    marked AS (SELECT r, string_agg('{TERM}:' || s || ':' || e, ',' ORDER BY s) AS terms FROM hits GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in patterns)}, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, terms) AS spans
    FROM own JOIN texts USING (text) LEFT JOIN base USING (r) LEFT JOIN marked USING (r)"""
