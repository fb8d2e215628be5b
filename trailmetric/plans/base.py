"""Bindings of the domain's records to the driver's tables, the same text in both engines, and result helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..sources import table

DIGITS = 6

#: One judged unit per line item.
FACTS = {
    "unit_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "order_id": "l_orderkey",
    "judge_model": "CASE WHEN l_suppkey % 2 = 0 THEN 'judge_a' ELSE 'judge_b' END",
    "version": "CASE WHEN l_suppkey % 3 = 0 THEN 'v1' WHEN l_suppkey % 3 = 1 THEN 'v2' ELSE 'v3' END",
    "perturbation_class": "CASE l_returnflag WHEN 'R' THEN 'placebo' WHEN 'A' THEN 'fine_grained' ELSE 'coarse_grained' END",
    "perturbation_family": "CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber % 4 = 0 THEN 'structural' WHEN l_linenumber % 4 = 1 THEN 'tool_selection' WHEN l_linenumber % 4 = 2 THEN 'parameter' ELSE 'data_reference' END",
    "perturbation_type": "CASE WHEN l_partkey % 3 = 0 THEN 'wrong_value' WHEN l_partkey % 3 = 1 THEN 'parameter' ELSE 'wrong_plan' END",
    "benchmark": "CASE l_linestatus WHEN 'O' THEN 'toolbench' ELSE 'swebench' END",
    "expected_impact": "l_linenumber % 4",
    "expected_detectability": "l_linenumber % 3",
    "error_detected": "l_quantity > 25",
    "error_confidence": "l_quantity / 50",
    "predicted_impact": "l_discount * 10",
    "predicted_failure_prob": "l_tax * 12.5",
    "outcome_degradation": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 25 - 0.5 END",
    "perturbed_success": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_partkey % 2 = 0 END",
    "target_step": "concat('s', l_linenumber % 5)",
    "predicted_step": "CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE concat('s', l_suppkey % 6) END",
    "predicted_error_type": "CASE WHEN l_partkey % 6 = 0 THEN 'planning' WHEN l_partkey % 6 = 1 THEN 'tool_selection' WHEN l_partkey % 6 = 2 THEN 'parameter' WHEN l_partkey % 6 = 3 THEN 'data_reference' WHEN l_partkey % 6 = 4 THEN 'other' ELSE NULL END",
    "human_error_detected": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey % 3 > 0 END",
    "human_error_step": "concat('s', l_partkey % 4)",
    "human_error_type": "CASE WHEN l_partkey % 4 = 0 THEN 'structural' WHEN l_partkey % 4 = 1 THEN 'parameter' WHEN l_partkey % 4 = 2 THEN 'planning' ELSE NULL END",
    "human_impact_tier": "CASE WHEN l_linenumber = 2 THEN NULL ELSE (l_partkey % 7) / 2.0 END",
    "overall_score": "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity * 2 END",
    "jps": "CASE WHEN l_linenumber <= 2 THEN l_quantity * 1.5 ELSE NULL END",
    "tcs": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (l_partkey % 12) * 10.0 END",
    "class_matches": "CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 5 = 1 THEN NULL ELSE 1 END",
    "clean_baseline": "CASE WHEN l_suppkey % 4 = 0 THEN false WHEN l_suppkey % 4 = 1 THEN NULL ELSE true END",
    "sample": "l_linenumber",
}
STEP_IDS = ("s0", "s1", "s2", "s3", "s4")


def _spark(expression: str) -> str:
    return expression


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{_spark(e)} AS {c}" for c, e in FACTS.items()])
    rows = rows.withColumn("step_ids", F.array(*map(F.lit, STEP_IDS)))
    for c in ("error_confidence", "predicted_impact", "predicted_failure_prob", "outcome_degradation", "human_impact_tier", "overall_score", "jps", "tcs"):
        rows = rows.withColumn(c, F.col(c).cast("double"))
    return rows.withColumn("true_impact_level", scoring.impact_level(F.col("outcome_degradation")))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.compare_to_human(scoring.evaluate_calibration(scoring.evaluate_detection(facts(spark, sf_dir))))


_LEVEL = "CASE WHEN outcome_degradation IS NULL THEN NULL WHEN outcome_degradation <= 0 THEN 0 WHEN outcome_degradation <= 0.25 THEN 1 WHEN outcome_degradation <= 0.5 THEN 2 ELSE 3 END"
_TIER = "CASE WHEN predicted_impact <= 0.25 THEN 0 WHEN predicted_impact <= 0.5 THEN 1 WHEN predicted_impact <= 0.75 THEN 2 ELSE 3 END"
_FAMILY = "CASE predicted_error_type WHEN 'planning' THEN 'structural' WHEN 'tool_selection' THEN 'tool_selection' WHEN 'parameter' THEN 'parameter' WHEN 'data_reference' THEN 'data_reference' END"
#: CTEs facts and evaluated, for DuckDB.
FACTS_SQL = f"""facts AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FACTS.items())} FROM lineitem),
leveled AS (SELECT *, {_LEVEL} AS true_impact_level, perturbation_class = 'placebo' AS placebo,
  error_detected AND perturbation_class <> 'placebo' AS is_tp, error_detected AND perturbation_class = 'placebo' AS is_fp,
  NOT error_detected AND perturbation_class = 'placebo' AS is_tn, NOT error_detected AND perturbation_class <> 'placebo' AS is_fn FROM facts),
evaluated AS (SELECT *,
  CASE WHEN is_tp AND predicted_step IS NOT NULL THEN predicted_step = target_step END AS localization_correct,
  CASE WHEN is_tp AND predicted_step IS NOT NULL AND predicted_step <> 's5' THEN abs(CAST(substr(predicted_step, 2) AS INT) - CAST(substr(target_step, 2) AS INT)) END AS localization_distance,
  CASE WHEN is_tp AND predicted_step IS NOT NULL AND predicted_step <> 's5' THEN abs(CAST(substr(predicted_step, 2) AS INT) - CAST(substr(target_step, 2) AS INT)) <= 1 END AS localization_near,
  CASE WHEN is_tp AND predicted_error_type IS NOT NULL THEN coalesce(predicted_error_type = perturbation_type OR predicted_error_type = perturbation_family, false) OR coalesce(({_FAMILY}) = perturbation_family, false) END AS type_correct,
  CASE WHEN expected_impact = 3 THEN error_detected END AS is_critical_detected,
  predicted_impact - greatest(0.0, least(1.0, outcome_degradation)) + CASE WHEN outcome_degradation IS NULL THEN NULL ELSE 0 END AS cce,
  CASE WHEN true_impact_level IS NOT NULL THEN predicted_impact > 0.5 AND true_impact_level <= 1 END AS over_reaction,
  CASE WHEN true_impact_level IS NOT NULL THEN predicted_impact < 0.5 AND true_impact_level = 3 END AS under_reaction,
  NOT perturbed_success AS failure_actual, {_TIER} AS tier, abs({_TIER} - true_impact_level) AS impact_tier_error,
  error_detected = human_error_detected AS detection_agrees,
  CASE WHEN error_detected AND human_error_detected THEN predicted_step = human_error_step END AS localization_agrees,
  CASE WHEN human_error_type IS NOT NULL AND predicted_error_type IS NOT NULL THEN coalesce(({_FAMILY}) = human_error_type, false) END AS type_agrees,
  {_TIER} - human_impact_tier AS impact_tier_diff
  FROM leveled)"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS digits, no negative zero, so that sums in another order give the same values."""
    return df.withColumns({f.name: F.round(f.name, DIGITS) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def r(expression: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0"


#: Annotations from events: 3 to a unit or so.
ANNOTATIONS = {
    "annotation_id": "event_id",
    "unit_id": "event_id % 3000",
    "annotator_id": "user_id",
    "seq": "event_id",
    "created_at": "ts",
    "error_detected": "value > 20",
    "error_trajectory": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END",
    "error_step_id": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('s', user_id % 3) END",
    "confidence": "user_id % 5 + 1",
    "error_type": "event_type",
    "impact_tier": "event_id % 4",
    "propagation_depth": "user_id % 6",
    "preference": "CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'B' ELSE 'tie' END",
    "time_spent_seconds": "value * 10",
    "tsd": "event_id % 2",
    "ser": "user_id % 5",
    "criticality": "event_id % 7",
}
ANNOTATIONS_SQL = f"ann AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ANNOTATIONS.items())} FROM events)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in ANNOTATIONS.items()])


def resampled_sql(source: str, keys: dict[str, str], replicates: int = 1000, seed: int = 42) -> str:
    """CTEs thresholds, cells, drawn(replicate, columns, w) and pairs: the draws of ``statistics.poisson_replicates`` by DuckDB; ``keys`` are columns and their texts."""
    columns = ", ".join(keys)
    text = " || '|' || ".join(f"coalesce({k}, 'null')" for k in keys.values())
    digit = lambda i: f"CAST('0x' || substr(sha, {8 * i + 1}, 8) AS BIGINT)"
    bits = " + ".join(f"CASE WHEN n & {1 << b} > 0 THEN len(list_filter((SELECT list(t) FROM thresholds WHERE m = {1 << b}), lambda t: t <= {digit(b)})) ELSE 0 END" for b in range(5))
    z = f"sqrt(-2 * ln(({digit(5)} + 0.5) / 4294967296)) * cos(2 * pi() * ({digit(6)} + 0.5) / 4294967296)"
    return f"""mass AS (SELECT m, j, sum(exp(-m + j * ln(m) - lgamma(j + 1.0))) OVER (PARTITION BY m ORDER BY j) AS p FROM (SELECT unnest([1.0, 2.0, 4.0, 8.0, 16.0]) AS m), range(100) x(j)),
    thresholds AS (SELECT CAST(m AS INT) AS m, CAST(floor(p * 4294967296) AS BIGINT) AS t FROM mass WHERE p < 1 - 1 / 8589934592),
    cells AS (SELECT {columns}, count(*) AS n, {text} AS k FROM {source} GROUP BY ALL),
    hashed AS (SELECT *, sha256('{seed}|' || replicate || '|' || k) AS sha FROM cells, range({replicates}) x(replicate)),
    normal AS (SELECT *, {z} AS z, n - (n & 31) AS high, {bits} AS low FROM hashed),
    drawn AS (SELECT replicate, {columns}, CAST(low + CASE WHEN high > 0 THEN greatest(0, floor(high + sqrt(high) * z + (z * z - 1) / 6 + 0.5)) ELSE 0 END AS BIGINT) AS w FROM normal WHERE low + high > 0)"""


def number_key(name: str) -> str:
    return f"(CAST(floor({name}) AS BIGINT) || ':' || CAST(floor(({name} - floor({name})) * 4503599627370496) AS BIGINT))"


#: CTEs that end in corrs(replicate, r): correlation of average ranks of x and y in each replicate of ``drawn``.
REPLICATE_SPEARMAN_SQL = """pairs AS (SELECT replicate, x, y, CAST(sum(w) AS DOUBLE) AS w FROM drawn WHERE w > 0 AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
    ranks AS (SELECT *, sum(w) OVER (PARTITION BY replicate ORDER BY x) - sum(w) OVER (PARTITION BY replicate, x) / 2 + 0.5 AS rx, sum(w) OVER (PARTITION BY replicate ORDER BY y) - sum(w) OVER (PARTITION BY replicate, y) / 2 + 0.5 AS ry FROM pairs),
    moments AS (SELECT replicate, sum(w) AS n, sum(w * rx * ry) - sum(w * rx) * sum(w * ry) / sum(w) AS c, sum(w * rx * rx) - sum(w * rx) * sum(w * rx) / sum(w) AS vx, sum(w * ry * ry) - sum(w * ry) * sum(w * ry) / sum(w) AS vy FROM ranks GROUP BY 1),
    corrs AS (SELECT replicate, c / (sqrt(vx) * sqrt(vy)) AS r FROM moments WHERE n >= 3 AND vx > 0 AND vy > 0)"""
