"""Queries over the analysis fact table: detection, calibration, gaps, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, statistics
from .base import FACTS_SQL, REPLICATE_SPEARMAN_SQL, evaluated, facts, number_key, r, resampled_sql, rounded

Q: dict = {}
S: dict[str, str] = {}
WITH = f"WITH {FACTS_SQL} "


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            S[name] = WITH + sql
        return f

    return add


_yes = lambda c: f"count(*) FILTER (WHERE {c})"
_div = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
_share = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
_TP, _FP, _TN, _FN, _REAL, _PLACEBO, _HITS = map(_yes, ("is_tp", "is_fp", "is_tn", "is_fn", "NOT placebo", "placebo", "is_tp"))
_P, _R = _div(_TP, f"({_TP} + {_FP})"), _div(_TP, f"({_TP} + {_FN})")


@query(
    "detection_rates",
    f"""SELECT count(*) AS n_total, {r(f'CASE WHEN {_REAL} > 0 THEN {_R} END')} AS pdr, {_REAL} AS pdr_n,
    {r(f'CASE WHEN {_PLACEBO} > 0 THEN {_div(_TN, f"({_TN} + {_FP})")} END')} AS pndr, {_PLACEBO} AS pndr_n,
    {r(_share(_yes('is_tp AND localization_correct'), _HITS))} AS sla, {r(_share(_yes('is_tp AND localization_near'), _HITS))} AS sla_pm1, {_HITS} AS sla_n,
    {r(_share(_yes('is_tp AND type_correct'), _HITS))} AS tia,
    {r(_share(_yes('NOT placebo AND expected_impact = 3 AND is_critical_detected'), _yes('NOT placebo AND expected_impact = 3')))} AS cer,
    {_yes('NOT placebo AND expected_impact = 3')} AS cer_n, {r(_P)} AS precision, {r(_R)} AS recall,
    {r(f'CASE WHEN {_P} + {_R} > 0 THEN 2 * {_P} * {_R} / ({_P} + {_R}) ELSE 0.0 END')} AS f1, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn FROM evaluated""",
)
def detection_rates(spark, d):
    return metrics.detection_metrics(evaluated(spark, d), with_auc=False)


_STRATA = {"by_class": "perturbation_class", "by_family": "perturbation_family", "by_detectability": "expected_detectability", "by_impact": "expected_impact", "by_benchmark": "benchmark"}


@query(
    "detection_by_stratum",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, coalesce(CAST({c} AS VARCHAR), 'None') AS stratum, count(*) AS n, {r(f'CASE WHEN {_REAL} > 0 THEN {_R} END')} AS pdr,
        {r(_share(_yes('is_tp AND localization_correct'), _HITS))} AS sla FROM evaluated GROUP BY 2"""
        for name, c in _STRATA.items()
    ),
)
def detection_by_stratum(spark, d):
    return metrics.detection_by_stratum(evaluated(spark, d))


@query(
    "calibration_rates",
    f"""SELECT count(outcome_degradation) AS ccorr_n, {r('avg(cce)')} AS mean_cce, {r('stddev_pop(cce)')} AS std_cce, {r('avg(abs(cce))')} AS abs_cce,
    {r(_share(_yes('true_impact_level <= 1 AND over_reaction'), _yes('true_impact_level <= 1')))} AS orr, {_yes('true_impact_level <= 1')} AS orr_n,
    {r(_share(_yes('true_impact_level = 3 AND under_reaction'), _yes('true_impact_level = 3')))} AS urr, {_yes('true_impact_level = 3')} AS urr_n,
    {r('avg(impact_tier_error)')} AS impact_mae, {r(_share(_yes('impact_tier_error = 0'), 'count(impact_tier_error)'))} AS impact_tier_exact FROM evaluated""",
)
def calibration_rates(spark, d):
    return metrics.calibration_metrics(evaluated(spark, d), with_correlation=False)


_CAL = {"by_true_impact": "true_impact_level", "by_class": "perturbation_class", "by_family": "perturbation_family", "by_benchmark": "benchmark"}


@query(
    "calibration_by_stratum",
    " UNION ALL ".join(f"SELECT '{name}' AS dimension, coalesce(CAST({c} AS VARCHAR), 'None') AS stratum, count(*) AS n, {r('avg(cce)')} AS mean_cce, {r('avg(abs(cce))')} AS abs_cce FROM evaluated GROUP BY 2" for name, c in _CAL.items()),
)
def calibration_by_stratum(spark, d):
    return metrics.calibration_by_stratum(evaluated(spark, d))


_BINS = "SELECT least(9, greatest(0, CASE " + " ".join(f"WHEN predicted_impact < {(i + 1) / 10!r} THEN {i}" for i in range(9)) + " ELSE 9 END)) AS bin, predicted_impact AS p, outcome_degradation AS a FROM facts"
_BINNED = f"""every AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)), b AS ({_BINS}),
g AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(a) AS ma FROM b GROUP BY bin)"""


@query("ece_bins", f", {_BINNED} SELECT e.bin, coalesce(n, 0) AS n, {r('mp')} AS mean_predicted, {r('ma')} AS mean_actual, {r('abs(mp - ma)')} AS gap FROM every e LEFT JOIN g ON e.bin = g.bin")
def ece_bins(spark, d):
    return metrics.ece_bins(facts(spark, d), "predicted_impact", "outcome_degradation")


@query("ece_mce", f", {_BINNED} SELECT {r('sum(n * abs(mp - ma)) / sum(n)')} AS ece, {r('max(abs(mp - ma))')} AS mce FROM g")
def ece_mce(spark, d):
    return metrics.expected_calibration_error(facts(spark, d), "predicted_impact", "outcome_degradation")


_FBIN = "CASE " + " ".join(f"WHEN p >= {i / 10!r} AND p < {(i + 1) / 10!r} THEN {i}" for i in range(10)) + " END"


@query(
    "failure_ece",
    f""", k AS (SELECT predicted_failure_prob AS p, CASE WHEN failure_actual THEN 1 ELSE 0 END AS y FROM evaluated WHERE failure_actual IS NOT NULL),
    g AS (SELECT {_FBIN} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM k GROUP BY 1)
    SELECT {r('sum(n * abs(acc - conf)) / (SELECT count(*) FROM k)')} AS failure_ece FROM g WHERE bin IS NOT NULL""",
)
def failure_ece(spark, d):
    return metrics.failure_ece(evaluated(spark, d))


_PROXY = "CASE WHEN predicted_impact < 1 THEN floor(predicted_impact * 3) ELSE 3 END"


@query(
    "proxy_calibration",
    f"""SELECT count(*) AS n, {r('avg(abs(predicted_impact - expected_impact / 3.0))')} AS proxy_mae, {r(_share(_yes(f'{_PROXY} = expected_impact'), 'count(*)'))} AS proxy_tier_accuracy,
    {r(_share(_yes('predicted_impact > 0.5 AND expected_impact <= 1'), _yes('expected_impact <= 1')))} AS proxy_orr,
    {r(_share(_yes('predicted_impact < 0.5 AND expected_impact = 3'), _yes('expected_impact = 3')))} AS proxy_urr FROM leveled WHERE NOT placebo""",
)
def proxy_calibration(spark, d):
    return metrics.proxy_calibration(facts(spark, d))


@query(
    "human_agreement",
    f"""SELECT {r('avg(CAST(detection_agrees AS INT))')} AS detection_agreement, {r('avg(CAST(localization_agrees AS INT))')} AS localization_agreement,
    {r('avg(CAST(type_agrees AS INT))')} AS type_agreement, {r('avg(abs(impact_tier_diff))')} AS tier_mae, {r('avg(impact_tier_diff)')} AS tier_bias FROM evaluated""",
)
def human_agreement(spark, d):
    return metrics.human_agreement(evaluated(spark, d))


_CCG = """, scored AS (SELECT *, coalesce(jps, 100 - overall_score) AS j, coalesce(tcs, 50.0) AS t FROM facts WHERE coalesce(jps, 100 - overall_score) IS NOT NULL),
gaps AS (SELECT *, (j - least(t, 100.0)) / nullif(least(t, 100.0), 0) AS ccg FROM scored) """
_DIMS = ["perturbation_class", "perturbation_family", "benchmark"]


def _ccg_part(dimension: str | None) -> str:
    value = f"CAST({dimension} AS VARCHAR)" if dimension else "''"
    where = f"WHERE {dimension} IS NOT NULL" if dimension else ""
    return f"""SELECT '{dimension or 'overall'}' AS dimension, {value} AS value, count(ccg) AS n, {r('avg(ccg)')} AS mean_ccg, {r('stddev_samp(ccg)')} AS std_ccg, {r('min(ccg)')} AS min_ccg,
    {r('max(ccg)')} AS max_ccg, {r('median(ccg)')} AS median_ccg, {r('avg(j)')} AS mean_jps, {r('avg(t)')} AS mean_tcs FROM gaps {where} {'GROUP BY 2' if dimension else ''}"""


@query("ccg_grouping_sets", _CCG + " UNION ALL ".join(map(_ccg_part, [None, *_DIMS])))
def ccg_grouping_sets(spark, d):
    return metrics.ccg_report(metrics.ccg_rows(facts(spark, d)), _DIMS)


@query(
    "ccg_exclusions",
    """, x AS (SELECT coalesce(jps, 100 - overall_score) AS j, least(coalesce(tcs, 50.0), 100.0) AS t FROM facts)
    SELECT count(j) AS total_evaluated, count(*) - count(j) AS no_score_skipped, count(*) FILTER (WHERE j IS NOT NULL AND t = 0) AS zero_tcs_excluded,
    count(*) FILTER (WHERE j IS NOT NULL AND t <> 0) AS valid FROM x""",
)
def ccg_exclusions(spark, d):
    return metrics.ccg_exclusions(facts(spark, d))


@query(
    "std_conventions",
    f"""SELECT perturbation_family, count(predicted_impact) AS n, {r('stddev_samp(predicted_impact)')} AS std_sample, {r('stddev_pop(predicted_impact)')} AS std_population,
    {r('coalesce(stddev_samp(predicted_impact), 0.0)')} AS std_or_zero FROM facts GROUP BY 1""",
)
def std_conventions(spark, d):
    return metrics.spreads(facts(spark, d), "perturbation_family", "predicted_impact")


_TABLE = "SELECT version, '{p}' AS population, perturbation_class, count(*) AS total, count(*) FILTER (WHERE error_detected) AS detected, round(100.0 * count(*) FILTER (WHERE error_detected) / count(*), 6) + 0.0 AS rate FROM facts WHERE {w} GROUP BY 1, 3"


@query("detection_table", " UNION ALL ".join(_TABLE.format(p=p, w=w) for p, w in (("all", "true"), ("class_validated", "coalesce(class_matches, 1) = 1"), ("clean_baseline", "coalesce(clean_baseline, true)"))))
def detection_table(spark, d):
    out = metrics.detection_table(facts(spark, d))
    return out.withColumn("rate", F.col("rate").cast("double"))


def _mode(column: str, name: str) -> str:
    return f"""{name}_v AS (SELECT unit_id, judge_model, {column} AS x, count(*) AS n, min(sample) AS f FROM o WHERE error_detected AND {column} IS NOT NULL GROUP BY ALL),
    {name}_m AS (SELECT *, row_number() OVER (PARTITION BY unit_id, judge_model ORDER BY n DESC, f, x) AS k, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY unit_id, judge_model) AS share FROM {name}_v)"""


_MEASURES = [("overall_score", "score"), ("error_confidence", "confidence"), ("predicted_impact", "impact"), ("predicted_failure_prob", "failure")]


@query(
    "judge_samples",
    f""", o AS (SELECT *, order_id AS unit_id FROM (SELECT * EXCLUDE (unit_id) FROM facts)), {_mode('predicted_step', 'step')}, {_mode('predicted_error_type', 'type')},
    s AS (SELECT unit_id, judge_model, count(*) AS samples, avg(CAST(error_detected AS INT)) AS dr, {', '.join(f'avg({c}) AS m_{n}, coalesce(stddev_samp({c}), 0.0) AS s_{n}' for c, n in _MEASURES)} FROM o GROUP BY ALL)
    SELECT s.unit_id, s.judge_model, samples, {r('dr')} AS detected_rate, {', '.join(f"{r(f'm_{n}')} AS mean_{n}, {r(f's_{n}')} AS std_{n}" for _, n in _MEASURES)},
      a.x AS modal_step, {r('coalesce(a.share, 0.0)')} AS step_agreement, b.x AS modal_type, {r('coalesce(b.share, 0.0)')} AS type_agreement
    FROM s LEFT JOIN step_m a ON s.unit_id = a.unit_id AND s.judge_model = a.judge_model AND a.k = 1 LEFT JOIN type_m b ON s.unit_id = b.unit_id AND s.judge_model = b.judge_model AND b.k = 1""",
)
def judge_samples(spark, d):
    return metrics.judge_samples(facts(spark, d).withColumn("unit_id", F.col("order_id")))


@query("distribution", " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce(CAST({c} AS VARCHAR), 'none') AS value, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM facts)')} AS percent FROM facts GROUP BY 2" for c in _DIMS))
def distribution(spark, d):
    return metrics.distribution(facts(spark, d), _DIMS).withColumn("percent", F.col("percent").cast("double"))


@query(
    "coverage",
    "SELECT value, required, count(perturbation_family) AS n, count(perturbation_family) >= required AS met FROM (VALUES ('structural', 10000), ('parameter', 100), ('other', 1)) w(value, required) LEFT JOIN facts ON perturbation_family = value GROUP BY 1, 2",
)
def coverage(spark, d):
    return metrics.coverage(facts(spark, d), "perturbation_family", {"structural": 10000, "parameter": 100, "other": 1})


@query("over_represented", f"SELECT perturbation_class AS value, count(*) AS n, {r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM facts)')} AS share FROM facts GROUP BY 1 HAVING count(*) > 0.33 * (SELECT count(*) FROM facts)")
def over_represented(spark, d):
    return metrics.over_represented(facts(spark, d), "perturbation_class", 0.33)


@query("crosstab", "SELECT benchmark, " + ", ".join(f"count(*) FILTER (WHERE perturbation_class = '{c}') AS {c}" for c in ("placebo", "fine_grained", "coarse_grained")) + " FROM facts GROUP BY 1")
def crosstab(spark, d):
    return metrics.crosstab(facts(spark, d), "benchmark", "perturbation_class", ["placebo", "fine_grained", "coarse_grained"])


_RANKED = "ranked AS (SELECT *, rank() OVER ({p} ORDER BY predicted_impact) + (count(*) OVER ({p1} predicted_impact) - 1) / 2.0 AS rx, rank() OVER ({p} ORDER BY outcome_degradation) + (count(*) OVER ({p1} outcome_degradation) - 1) / 2.0 AS ry FROM facts WHERE outcome_degradation IS NOT NULL)"


@query("spearman", ", " + _RANKED.format(p="", p1="PARTITION BY") + f" SELECT count(*) AS n, {r('corr(rx, ry)')} AS spearman FROM ranked")
def spearman(spark, d):
    return statistics.spearman(facts(spark, d), "predicted_impact", "outcome_degradation")


@query("spearman_by_stratum", ", " + _RANKED.format(p="PARTITION BY perturbation_class", p1="PARTITION BY perturbation_class,") + f" SELECT perturbation_class, count(*) AS n, {r('corr(rx, ry)')} AS spearman FROM ranked GROUP BY 1")
def spearman_by_stratum(spark, d):
    return statistics.spearman(facts(spark, d), "predicted_impact", "outcome_degradation", by=["perturbation_class"])


@query("pearson", f"SELECT count(*) AS n, {r('corr(predicted_impact, outcome_degradation)')} AS pearson FROM facts WHERE outcome_degradation IS NOT NULL")
def pearson(spark, d):
    return statistics.pearson(facts(spark, d), "predicted_impact", "outcome_degradation")


@query(
    "auc_rank",
    f""", k AS (SELECT NOT placebo AS y, rank() OVER (ORDER BY error_confidence) + (count(*) OVER (PARTITION BY error_confidence) - 1) / 2.0 AS rk FROM leveled),
    c AS (SELECT CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT y) AS DOUBLE) AS n0, sum(rk) FILTER (WHERE y) AS s FROM k)
    SELECT {r('(s - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auc FROM c""",
)
def auc_rank(spark, d):
    return statistics.auc(facts(spark, d), F.col("perturbation_class") != "placebo", "error_confidence")


@query(
    "cohens_d",
    f""", s AS (SELECT count(*) FILTER (WHERE placebo) AS n1, count(*) FILTER (WHERE NOT placebo) AS n2, avg(predicted_impact) FILTER (WHERE placebo) AS m1,
    avg(predicted_impact) FILTER (WHERE NOT placebo) AS m2, var_samp(predicted_impact) FILTER (WHERE placebo) AS v1, var_samp(predicted_impact) FILTER (WHERE NOT placebo) AS v2 FROM leveled)
    SELECT n1, n2, {r('m1')} AS mean1, {r('m2')} AS mean2, {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))')} AS d FROM s""",
)
def cohens_d(spark, d):
    return statistics.cohens_d(facts(spark, d), "predicted_impact", F.col("perturbation_class") == "placebo", F.col("perturbation_class") != "placebo")


@query(
    "anova_eta",
    f""", x AS (SELECT perturbation_family AS g, error_confidence AS v FROM facts WHERE perturbation_family IS NOT NULL),
    per AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS vp FROM x GROUP BY g),
    s AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum(n * vp) AS ssw FROM per)
    SELECT groups, n, {r('ssb')} AS ss_between, {r('ssw')} AS ss_within, {r('(ssb / (groups - 1)) / (ssw / (n - groups))')} AS f, {r('ssb / (ssb + ssw)')} AS eta2 FROM s""",
)
def anova_eta(spark, d):
    return statistics.anova(facts(spark, d), "error_confidence", "perturbation_family")


@query(
    "bootstrap_ci",
    f""", v AS (SELECT CAST(CAST(error_detected AS INT) AS DOUBLE) AS v FROM leveled WHERE NOT placebo AND error_detected IS NOT NULL), {resampled_sql("v", {"v": number_key("v")})},
    per AS (SELECT sum(w * v) / sum(w) AS pdr FROM drawn WHERE w > 0 GROUP BY replicate)
    SELECT {r("avg(pdr)")} AS mean, {r("quantile_cont(pdr, 0.025)")} AS low, {r("quantile_cont(pdr, 0.975)")} AS high, count(pdr) AS replicates FROM per""",
)
def bootstrap_ci(spark, d):
    rows = facts(spark, d).filter("perturbation_class <> 'placebo'")
    return statistics.bootstrap_ci(rows.withColumn("hit", F.col("error_detected").cast("int")), "pdr", "hit")


@query(
    "correlation_interval",
    f""", v AS (SELECT CAST(predicted_impact AS DOUBLE) AS x, CAST(outcome_degradation AS DOUBLE) AS y FROM facts WHERE predicted_impact IS NOT NULL AND outcome_degradation IS NOT NULL),
    {resampled_sql("v", {"x": number_key("x"), "y": number_key("y")})}, {REPLICATE_SPEARMAN_SQL}, s AS (SELECT list(r ORDER BY r) AS l, count(*) AS n FROM corrs)
    SELECT {r("l[CAST(floor(n * 0.025) AS INT) + 1]")} AS low, {r("l[CAST(floor(n * 0.975) AS INT)]")} AS high FROM s""",
)
def correlation_interval(spark, d):
    return statistics.correlation_interval(facts(spark, d), "predicted_impact", "outcome_degradation")


@query(
    "tukey_pairs",
    f""", x AS (SELECT perturbation_type AS g, predicted_impact AS v FROM facts WHERE predicted_impact IS NOT NULL AND perturbation_type IS NOT NULL),
    s AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS v FROM x GROUP BY 1), w AS (SELECT count(*) AS groups, sum(n) - count(*) AS df, sum(n * v) AS ss FROM s)
    SELECT a.g AS group1, b.g AS group2, {r("b.m - a.m")} AS difference, {r("abs(a.m - b.m) / sqrt(ss / df / 2 * (1.0 / a.n + 1.0 / b.n))")} AS q, groups, CAST(df AS BIGINT) AS df FROM s a JOIN s b ON a.g < b.g, w""",
)
def tukey_pairs(spark, d):
    return statistics.tukey_pairs(facts(spark, d), "predicted_impact", "perturbation_type")
