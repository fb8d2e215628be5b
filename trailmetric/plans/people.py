"""Queries over annotations and samples: votes, agreement, quality control, quotas, assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, relational, sampling, statistics
from ..sources import table
from .base import ANNOTATIONS_SQL, FACTS_SQL, annotations, facts, r, rounded

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            S[name] = sql
        return f

    return add


A = f"WITH {ANNOTATIONS_SQL}"


def _vote(column: str, name: str) -> str:
    return f"""{name}_v AS (SELECT unit_id, {column} AS x, count(*) AS n, min(seq) AS f FROM ann WHERE {column} IS NOT NULL GROUP BY ALL),
    {name} AS (SELECT unit_id, first_value(x) OVER w AS {name}_majority, CASE WHEN sum(n) OVER (PARTITION BY unit_id) < 2 THEN 1.0 ELSE CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY unit_id) END AS {name}_agreement,
      row_number() OVER w AS k FROM {name}_v WINDOW w AS (PARTITION BY unit_id ORDER BY n DESC, f))"""


@query("vote_first_seen", f"{A}, {_vote('error_type', 'type')} SELECT unit_id, type_majority, {r('type_agreement')} AS type_agreement FROM type WHERE k = 1")
def vote_first_seen(spark, d):
    return labels.majority(annotations(spark, d), "unit_id", "error_type", "seq", "type")


_DIMS = (("error_detected", "detected"), ("error_trajectory", "trajectory"), ("error_step_id", "step"), ("error_type", "type"), ("preference", "preference"))


@query(
    "label_aggregation",
    f"""{A}, {', '.join(_vote(c, n) for c, n in _DIMS)},
    base AS (SELECT unit_id, list(annotation_id ORDER BY seq) AS annotation_ids, count(DISTINCT annotator_id) AS num_annotators, avg(confidence) AS mc, avg(impact_tier) AS mt, stddev_pop(impact_tier) AS st,
      avg(propagation_depth) AS mp, CASE WHEN count(DISTINCT error_step_id) = 1 THEN 'exact' WHEN count(DISTINCT error_step_id) > 1 THEN 'mixed' END AS localization_agreement FROM ann GROUP BY 1)
    SELECT base.unit_id, array_to_string(annotation_ids, ',') AS annotation_ids, num_annotators, {r('mc')} AS mean_confidence, {r('mt')} AS mean_impact_tier, {r('st')} AS impact_tier_std, {r('mp')} AS mean_propagation_depth,
      {', '.join(f'{n}.{n}_majority, {r(f"{n}.{n}_agreement")} AS {n}_agreement' for _, n in _DIMS)}, localization_agreement,
      coalesce(detected_agreement < 0.6, false) OR coalesce(trajectory_agreement < 0.6, false) OR coalesce(preference_agreement < 0.6, false) AS low_agreement_flag,
      coalesce(detected_agreement < 0.6, false) OR coalesce(trajectory_agreement < 0.6, false) AS needs_adjudication
    FROM base {' '.join(f'LEFT JOIN {n} ON base.unit_id = {n}.unit_id AND {n}.k = 1' for _, n in _DIMS)}""",
)
def label_aggregation(spark, d):
    return labels.aggregate_labels(annotations(spark, d)).withColumn("annotation_ids", F.array_join("annotation_ids", ","))


@query(
    "aggregation_summary",
    f"""{A}, {_vote('error_detected', 'detected')}, {_vote('error_trajectory', 'trajectory')}, {_vote('error_type', 'type')}, {_vote('preference', 'preference')},
    u AS (SELECT unit_id, count(DISTINCT annotator_id) AS na FROM ann GROUP BY 1),
    j AS (SELECT na, d.detected_agreement AS da, y.type_agreement AS ta, coalesce(d.detected_agreement < 0.6, false) OR coalesce(t.trajectory_agreement < 0.6, false) AS adj, coalesce(f.preference_agreement < 0.6, false) AS pl
      FROM u LEFT JOIN detected d ON d.unit_id = u.unit_id AND d.k = 1 LEFT JOIN trajectory t ON t.unit_id = u.unit_id AND t.k = 1 LEFT JOIN type y ON y.unit_id = u.unit_id AND y.k = 1 LEFT JOIN preference f ON f.unit_id = u.unit_id AND f.k = 1)
    SELECT count(*) AS units, count(*) FILTER (WHERE adj OR pl) AS low_agreement, count(*) FILTER (WHERE adj) AS adjudication, {r('avg(da)')} AS mean_detected_agreement, {r('avg(ta)')} AS mean_type_agreement, {r('avg(na)')} AS mean_annotators FROM j""",
)
def aggregation_summary(spark, d):
    return labels.aggregation_summary(labels.aggregate_labels(annotations(spark, d)))


_MAJORITIES = ("detected", "trajectory", "preference")


@query(
    "majority_distributions",
    f"""{A}, {', '.join(_vote(c, n) for c, n in _DIMS if n in _MAJORITIES)},
    m AS ({' UNION ALL '.join(f"SELECT '{n}' AS dimension, CAST({n}_majority AS VARCHAR) AS value, {n}_agreement AS a FROM {n} WHERE k = 1" for n in _MAJORITIES)})
    SELECT dimension, value, count(*) AS units, {r('count(*) / sum(count(*)) OVER (PARTITION BY dimension)')} AS share, {r('avg(a)')} AS mean_agreement FROM m GROUP BY 1, 2""",
)
def majority_distributions(spark, d):
    return labels.majority_distributions(labels.aggregate_labels(annotations(spark, d)), _MAJORITIES)


_ALPHA = """{n}_x AS (SELECT unit_id AS u, annotator_id AS a, CAST(arg_max({v}, seq) AS VARCHAR) AS v FROM ann WHERE {v} IS NOT NULL GROUP BY ALL),
{n}_o AS (SELECT u, a, v FROM {n}_x WHERE u IN (SELECT u FROM {n}_x GROUP BY u HAVING count(*) > 1)),
{n}_t AS (SELECT v, count(*) AS n, row_number() OVER (ORDER BY v) - 1 AS c FROM {n}_o GROUP BY v),
{n}_i AS (SELECT coalesce(sum({bad}), 0) AS bad FROM (SELECT u, a, x.v, c FROM {n}_o x JOIN {n}_t USING (v)) l JOIN (SELECT u, a, x.v, c FROM {n}_o x JOIN {n}_t USING (v)) r ON l.u = r.u AND l.a < r.a),
{n}_e AS (SELECT coalesce(sum(l.n * r.n * {bad}), 0) AS bad FROM {n}_t l JOIN {n}_t r ON l.v < r.v),
{n}_z AS (SELECT (SELECT count(DISTINCT u) FROM {n}_o) AS n_units, (SELECT count(DISTINCT a) FROM {n}_x) AS n_annotators, (SELECT count(*) FROM {n}_x) AS n_observations,
  {n}_i.bad / (m * (m - 1) / 2.0) AS ob, {n}_e.bad / (m * (m - 1) / 2.0) AS ex, 1 - ob / ex AS alpha FROM {n}_i, {n}_e, (SELECT CAST(count(*) AS DOUBLE) AS m FROM {n}_o))"""
_BAND = "CASE WHEN alpha >= 0.8 THEN 'high' WHEN alpha >= 0.6 THEN 'acceptable' WHEN alpha >= 0.4 THEN 'moderate' ELSE 'low' END"
_NOMINAL, _SQUARED = "CASE WHEN l.v = r.v THEN 0 ELSE 1 END", "(l.c - r.c) * (l.c - r.c)"


def _alpha(v: str, bad: str) -> str:
    return f"{A}, {_ALPHA.format(n='q', v=v, bad=bad)} SELECT n_units, n_annotators, n_observations, {r('ob')} AS observed, {r('ex')} AS expected, {r('alpha')} AS alpha, {_BAND} AS band FROM q_z"


@query("alpha_pooled_nominal", _alpha("error_type", _NOMINAL))
def alpha_nominal(spark, d):
    return statistics.pooled_alpha(annotations(spark, d), "unit_id", "error_type")


@query("alpha_pooled_ordinal", _alpha("confidence", _SQUARED))
def alpha_ordinal(spark, d):
    return statistics.pooled_alpha(annotations(spark, d), "unit_id", "confidence", level="ordinal")


@query("alpha_pooled_interval", _alpha("propagation_depth", _SQUARED))
def alpha_interval(spark, d):
    return statistics.pooled_alpha(annotations(spark, d), "unit_id", "propagation_depth", level="interval")


_REPORT = {name: kind for name, kind in labels.DIMENSIONS.items()}


@query(
    "agreement_report",
    f"{A}, "
    + ", ".join(_ALPHA.format(n=c, v=c, bad=_NOMINAL if kind == "nominal" else _SQUARED) for c, (kind, _) in _REPORT.items())
    + ", parts AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS dimension, alpha, CAST({t} AS DOUBLE) AS threshold FROM {c}_z" for c, (_, t) in _REPORT.items())
    + f") SELECT dimension, {r('alpha')} AS alpha, {_BAND} AS band, threshold, alpha >= threshold AS met, (SELECT avg(CAST(alpha >= threshold AS INT)) >= 0.8 FROM parts) AS acceptable FROM parts",
)
def agreement_report(spark, d):
    return labels.agreement_report(annotations(spark, d))


_PAIRS = """x AS (SELECT unit_id AS u, annotator_id AS a, arg_max(error_trajectory, seq) AS v FROM ann WHERE error_trajectory IS NOT NULL GROUP BY ALL),
    m AS (SELECT l.a AS a1, q.a AS a2, count(*) AS shared, count(*) FILTER (WHERE l.v = q.v) AS agreed FROM x l JOIN x q ON l.u = q.u AND l.a < q.a GROUP BY ALL),
    p AS (SELECT DISTINCT a FROM x), every AS (SELECT p.a AS a1, q.a AS a2, coalesce(shared, 0) AS shared, coalesce(agreed, 0) AS agreed, CAST(agreed AS DOUBLE) / shared AS rate
    FROM p JOIN p q ON p.a < q.a LEFT JOIN m ON m.a1 = p.a AND m.a2 = q.a)"""


@query("pairwise_agreement", f"{A}, {_PAIRS} SELECT a1, a2, shared, agreed, {r('rate')} AS rate FROM every")
def pairwise_agreement(spark, d):
    return statistics.pairwise_agreement(annotations(spark, d), "unit_id", "annotator_id", "error_trajectory")


@query("overall_agreement", f"{A}, {_PAIRS} SELECT CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(agreed) AS BIGINT) AS agreed, {r('CAST(sum(agreed) AS DOUBLE) / sum(shared)')} AS rate FROM every")
def overall_agreement(spark, d):
    return statistics.overall_agreement(annotations(spark, d), "unit_id", "annotator_id", "error_trajectory")


@query(
    "annotator_agreement",
    f"{A}, {_PAIRS} SELECT a AS annotator, count(*) AS n_annotations, (SELECT {r('avg(rate)')} FROM every WHERE a1 = x.a OR a2 = x.a) AS mean_agreement FROM x GROUP BY a",
)
def annotator_agreement(spark, d):
    return statistics.annotator_agreement(annotations(spark, d), "unit_id", "annotator_id", "error_trajectory")


_RUNS = """{A}, c AS (SELECT annotator_id, error_trajectory AS v, seq, CASE WHEN error_trajectory IS NULL OR coalesce(error_trajectory <> lag(error_trajectory) OVER w, true) THEN 1 ELSE 0 END AS ch,
  row_number() OVER w - 1 AS pos FROM ann WINDOW w AS (PARTITION BY annotator_id ORDER BY created_at, seq)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY annotator_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM c),
g AS (SELECT annotator_id, island, count(*) AS n, min(pos) AS s, max(pos) AS e, any_value(v) AS v FROM i WHERE v IS NOT NULL GROUP BY ALL) """


@query("runs_islands", _RUNS.format(A=A) + "SELECT annotator_id, max(n) AS longest_run, max(n) >= 5 AS flagged FROM g GROUP BY 1")
def runs_islands(spark, d):
    return labels.runs(annotations(spark, d), "annotator_id", "error_trajectory", [F.col("created_at"), F.col("seq")])


@query("flagged_runs", _RUNS.format(A=A) + 'SELECT annotator_id, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", v AS value, 4 AS length FROM g WHERE n >= 4')
def flagged_runs(spark, d):
    return labels.flagged_runs(annotations(spark, d), "annotator_id", "error_trajectory", [F.col("created_at"), F.col("seq")], threshold=4)


@query(
    "time_bounds",
    f"""{A} SELECT annotator_id, count(time_spent_seconds) AS n, count(*) FILTER (WHERE time_spent_seconds < 60) AS fast, count(*) FILTER (WHERE time_spent_seconds > 600) AS slow,
    count(*) FILTER (WHERE time_spent_seconds BETWEEN 60 AND 600) AS passed, {r('avg(time_spent_seconds)')} AS mean_time, {r('median(time_spent_seconds)')} AS median_time FROM ann GROUP BY 1""",
)
def time_bounds(spark, d):
    return labels.time_bounds(annotations(spark, d), 60, 600, by="annotator_id")


@query(
    "gold_accuracy",
    f"""{A}, gold AS (SELECT unit_id, error_detected AS gd, error_trajectory AS gt FROM ann QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq) = 1),
    j AS (SELECT annotator_id, CASE WHEN error_detected IS NOT DISTINCT FROM gd THEN 1 ELSE 0 END + CASE WHEN error_trajectory IS NOT DISTINCT FROM gt THEN 1 ELSE 0 END AS h FROM ann JOIN gold ON ann.unit_id = gold.unit_id),
    p AS (SELECT annotator_id, count(*) * 2 AS compared, CAST(sum(h) AS BIGINT) AS correct FROM j GROUP BY 1)
    SELECT a.annotator_id, coalesce(compared, 0) AS compared, coalesce(correct, 0) AS correct, {r('CAST(correct AS DOUBLE) / compared')} AS accuracy,
    CASE WHEN compared IS NULL THEN 'no_gold_overlap' WHEN CAST(correct AS DOUBLE) / compared >= 0.8 THEN 'passing' WHEN CAST(correct AS DOUBLE) / compared >= 0.7 THEN 'warning' ELSE 'recalibrate' END AS status
    FROM (SELECT DISTINCT annotator_id FROM ann) a LEFT JOIN p ON a.annotator_id = p.annotator_id""",
)
def gold_accuracy(spark, d):
    rows = annotations(spark, d)
    gold = relational.first_by(rows.select("unit_id", "seq", "error_detected", "error_trajectory"), ["unit_id"], [F.col("seq")])
    return labels.gold_accuracy(rows, gold, "annotator_id", "unit_id", ["error_detected", "error_trajectory"])


@query(
    "annotator_quality",
    f"""{A}, q AS (SELECT annotator_id, avg(CASE WHEN time_spent_seconds < 60 THEN 1.0 ELSE 0.0 END) AS i, max(time_spent_seconds) > 3000 AS fl, CASE WHEN annotator_id % 3 = 0 THEN NULL ELSE 0.75 END AS g FROM ann GROUP BY annotator_id),
    o AS (SELECT *, 1 - 0.3 * i - 0.2 * CASE WHEN fl THEN 1 ELSE 0 END AS s FROM q)
    SELECT annotator_id, {r('greatest(0.0, least(1.0, CASE WHEN g IS NULL THEN s ELSE 0.7 * s + 0.3 * g END))')} AS quality FROM o""",
)
def annotator_quality(spark, d):
    per = annotations(spark, d).groupBy("annotator_id").agg(F.avg((F.col("time_spent_seconds") < 60).cast("double")).alias("i"), (F.max("time_spent_seconds") > 3000).alias("fl"))
    gold = F.when(F.col("annotator_id") % 3 == 0, None).otherwise(0.75)
    return per.select("annotator_id", labels.annotator_quality(F.col("i"), F.col("fl"), gold).cast("double").alias("quality"))


@query(
    "annotation_summary",
    f"""{A} SELECT count(*) AS n, count(DISTINCT annotator_id) AS annotators, {', '.join(f'{r(f"{f}(CAST({e} AS DOUBLE))")} AS {n}_{c}' for c, e in (('tsd', 'tsd'), ('ser', 'ser'), ('tcs', 'tsd * 100 + ser * 10')) for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} FROM ann""",
)
def annotation_summary(spark, d):
    rows = annotations(spark, d)
    return labels.annotation_summary(rows.withColumns({"tsd": F.col("tsd").cast("double"), "ser": F.col("ser").cast("double")}))


@query("range_errors", f"{A} SELECT annotation_id, concat_ws(',', CASE WHEN NOT ser BETWEEN 0 AND 3 THEN 'ser' END, CASE WHEN NOT criticality BETWEEN 1 AND 5 THEN 'criticality' END) AS errors FROM ann")
def range_errors(spark, d):
    return labels.range_errors(annotations(spark, d)).select("annotation_id", F.array_join("errors", ",").alias("errors"))


# -- sampling: documents as units, in MD5 order in both engines -----------------
_KEY = "md5(concat('42:', doc_id))"


@query("shuffled_head", f"SELECT doc_id FROM documents ORDER BY {_KEY}, doc_id LIMIT 100")
def shuffled_head(spark, d):
    return sampling.shuffled_head(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


_RANK = f"row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id)"
_QUOTA = "CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 30 WHEN 'fr' THEN 5000 ELSE 0 END"


@query("quota_sample", f"SELECT doc_id, lang FROM (SELECT *, {_RANK} AS k FROM documents) WHERE k <= {_QUOTA}")
def quota_sample(spark, d):
    quotas = {"en": 50, "de": 30, "fr": 5000}
    return sampling.per_stratum(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", sampling.quota_column("lang", quotas), most=max(quotas.values()))


_FILL = "CASE lang WHEN 'en' THEN 10 WHEN 'de' THEN 20 WHEN 'xx' THEN 400 ELSE 0 END"


@query(
    "quota_fill",
    f"""WITH k AS (SELECT doc_id, lang, {_RANK} AS k, {_FILL} AS q FROM documents)
    SELECT doc_id, lang FROM k ORDER BY CASE WHEN k > q THEN 1 ELSE 0 END, CASE WHEN k <= q THEN 0 WHEN lang = 'fr' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END, {_KEY}, doc_id LIMIT 430""",
)
def quota_fill(spark, d):
    return sampling.with_fill(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 10, "de": 20, "xx": 400}, ["fr", "de"])


@query("downsample", f"SELECT doc_id, lang FROM (SELECT *, {_RANK} AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 60 WHEN 'es' THEN 25 ELSE 0 END")
def downsample(spark, d):
    return sampling.downsample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 100, {"en": 0.6, "es": 0.25}, "doc_id")


_SAMPLE = f"s AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS position FROM documents)"


@query("round_robin", f"WITH {_SAMPLE} SELECT doc_id, CAST(position AS INT) AS position, CASE position % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE 'cid' END AS annotator FROM s")
def round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("doc_id"), "doc_id", ["ann", "bob", "cid"])


@query("batches", "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 25) AS INT) AS batch FROM documents")
def batches(spark, d):
    return sampling.batched(table(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")])


@query(
    "overlap_assignment",
    f"""WITH {_SAMPLE}, w AS (SELECT *, CASE WHEN position < 10 THEN ['ann', 'bob', 'cid']
      WHEN position < 30 THEN CASE (position - 10) % 3 WHEN 0 THEN ['ann', 'bob'] WHEN 1 THEN ['ann', 'cid'] ELSE ['bob', 'cid'] END
      ELSE CASE (position - 30) % 3 WHEN 0 THEN ['ann'] WHEN 1 THEN ['bob'] ELSE ['cid'] END END AS who FROM s)
    SELECT doc_id, CAST(position AS INT) AS position, unnest(who) AS annotator FROM w""",
)
def overlap_assignment(spark, d):
    return sampling.overlap(table(spark, d, "documents").select("doc_id"), "doc_id", ["ann", "bob", "cid"], to_all=10, paired=20)


_CASCADE = [("high", "n_chars > 4000", 30), ("english", "lang = 'en'", 40), ("rest", "true", 20)]


def _cascade_sql() -> str:
    ctes, last = [f"c0 AS (SELECT doc_id, n_chars, lang, {_KEY} AS h, CAST(NULL AS VARCHAR) AS stage FROM documents)"], "c0"
    for i, (name, cond, quota) in enumerate(_CASCADE, 1):
        ctes.append(f"c{i} AS (SELECT doc_id, n_chars, lang, h, CASE WHEN ({cond}) AND stage IS NULL AND row_number() OVER (PARTITION BY ({cond}) AND stage IS NULL ORDER BY h, doc_id) <= {quota} THEN '{name}' ELSE stage END AS stage FROM {last})")
        last = f"c{i}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, n_chars, lang, coalesce(stage, 'fill') AS stage FROM {last} ORDER BY CASE WHEN stage IS NULL THEN 1 ELSE 0 END, h, doc_id LIMIT 120"


@query("cascade_sample", _cascade_sql())
def cascade_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return sampling.cascade(rows, [(n, F.expr(c), q) for n, c, q in _CASCADE], 120, "doc_id")


@query(
    "class_needs",
    f"""WITH {FACTS_SQL}, w AS (SELECT * FROM (VALUES ('placebo', 30000, 0), ('fine_grained', 25000, 1), ('other', 4000, 2)) v(class, target, o)),
    n AS (SELECT class, target, o, count(perturbation_class) AS n FROM w LEFT JOIN facts ON perturbation_class = class GROUP BY ALL), k AS (SELECT *, greatest(target - n, 0) AS need FROM n)
    SELECT class, target, n, need, class = (SELECT class FROM k ORDER BY need DESC, o LIMIT 1) AS suggested FROM k""",
)
def class_needs(spark, d):
    return sampling.class_needs(facts(spark, d), "perturbation_class", {"placebo": 30000, "fine_grained": 25000, "other": 4000})
