"""Quality gates: each is one aggregation that gives one report row.

Report columns: gate, status (pass, fail, warn, skip), value, threshold, checked, violations and
up to five examples (the first by id).  A gate on no rows is skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

EXAMPLES = 5
REPORT = "gate string, status string, value double, threshold double, checked bigint, violations bigint, examples array<string>"

#: Markers of synthetic values, short list of pipeline runs and long list of perturbation checks.
MARKERS_SHORT = ("old", "mutated", "wrong", "backup", "test", "v1")
MARKERS_LONG = (*MARKERS_SHORT, "original", "modified", "perturbed", "changed")
#: Text that repeats where it should not.
CORRUPTIONS = {
    "duplicate_action": r"Action:.*Action:",
    "duplicate_tool": r"Tool:.*Tool:",
    "duplicate_thought": r"Thought:.*Thought:",
    "nested_json_corruption": r"\{.*\{.*\}.*\}.*\{",
    "step_marker_repetition": r"Step \d+.*Step \d+.*Step \d+",
}
#: Phrases that give an evaluation prompt away.
PRIMING = (
    r"one.*contain.*error", r"one.*has.*error", r"find.*the.*error", r"identify.*the.*error", r"which.*has.*error",
    r"which.*contains.*error", r"the.*error.*is", r"there.*is.*an.*error", r"may.*contain.*error",
)
LEAKS = (r"\bbaseline\b", r"\bperturbed\b", r"\boriginal\b", r"\bmodified\b", r"\bcorrect.*trajectory\b", r"\bincorrect.*trajectory\b", r"\bground.*truth\b")
VOCABULARY = ("planning", "tool_selection", "parameter", "data_reference", "other")


def has_marker(value: Column, markers: tuple[str, ...] = MARKERS_SHORT) -> Column:
    return F.coalesce(value.rlike("(?i)_(" + "|".join(markers) + r")\b"), F.lit(False))


def corruption(text: Column) -> Column:
    """Name of the first corruption pattern found over lines, or null."""
    return reduce(lambda acc, p: acc.when(text.rlike("(?is)" + p[1]), p[0]), CORRUPTIONS.items(), F.when(F.lit(False), ""))


def repeated_action(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)Action:.*Action:"), F.lit(False))


def looks_json(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"^[{\[]"), F.lit(False))


def parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def report(df: DataFrame, gate: str, violation: Column, row_id: str, value: Column, threshold: float, ok, checked: Column | None = None, warn: bool = False) -> DataFrame:
    """``value`` aggregates the rows; ``ok`` is a Column function of it."""
    bad = F.coalesce(violation, F.lit(False))
    out = _with_examples(df, bad, row_id, value, checked)
    status = F.when(F.col("checked") == 0, "skip").when(ok(F.col("value")), "pass").otherwise("warn" if warn else "fail")
    return out.select(F.lit(gate).alias("gate"), status.alias("status"), "value", F.lit(float(threshold)).alias("threshold"), "checked", "violations", "examples")


def _with_examples(df: DataFrame, bad: Column, row_id: str, value: Column, checked: Column | None) -> DataFrame:
    counts = df.agg(
        F.count_if(F.lit(True) if checked is None else F.coalesce(checked, F.lit(False))).alias("checked"),
        F.count_if(bad).alias("violations"),
        value.cast("double").alias("value"),
    )
    shown = df.filter(bad).select(F.col(row_id).cast("string").alias("id")).orderBy("id").limit(EXAMPLES).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return counts.join(shown)


def rate(condition: Column, over: Column | None = None) -> Column:
    """Share of rows (of those ``over``) that meet a condition; null without any."""
    flag = F.coalesce(condition, F.lit(False)).cast("int")
    return F.avg(flag if over is None else F.when(F.coalesce(over, F.lit(False)), flag))


def trajectory_count(df: DataFrame, row_id: str, least: int = 100) -> DataFrame:
    out = report(df, "trajectory_count", F.lit(False), row_id, F.count(F.lit(1)), least, lambda v: v >= least)
    return out.withColumn("status", F.when(F.col("value") >= least, "pass").otherwise("fail"))


def grader_pass_rate(df: DataFrame, row_id: str, least: float = 0.3) -> DataFrame:
    passed = F.coalesce("grader_passed", "task_success", F.lit(False))
    return report(df, "grader_pass_rate", ~passed, row_id, rate(passed), least, lambda v: v >= least)


def no_synthetic_markers(df: DataFrame, row_id: str, column: str, most: float = 0.0, markers=MARKERS_SHORT) -> DataFrame:
    bad = has_marker(F.col(column), markers)
    return report(df, "no_synthetic_markers", bad, row_id, rate(bad), most, lambda v: v <= most)


def no_structural_corruption(df: DataFrame, row_id: str, column: str, all_patterns: bool = False) -> DataFrame:
    bad = corruption(F.col(column)).isNotNull() if all_patterns else repeated_action(F.col(column))
    return report(df, "no_structural_corruption", bad, row_id, rate(bad), 0.0, lambda v: v <= 0)


def json_validity(df: DataFrame, row_id: str, column: str, least: float = 1.0, over_checked: bool = False) -> DataFrame:
    """Texts that start as JSON must parse; the rate is over all rows or over those."""
    candidate = looks_json(F.col(column))
    bad = candidate & ~parses(F.col(column))
    return report(df, "json_validity", bad, row_id, rate(~bad, candidate if over_checked else None), least, lambda v: v >= least, candidate if over_checked else None)


def position_distribution(df: DataFrame, row_id: str, column: str, most: float = 0.4) -> DataFrame:
    late = F.col(column) == "late"
    return report(df, "position_distribution", late, row_id, rate(late), most, lambda v: v <= most)


def class_distribution(df: DataFrame, row_id: str, column: str, targets: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """The largest distance of a known class's share from its target."""
    known = F.col(column).isin(*targets)
    n = F.count_if(known)
    gaps = [F.abs(F.count_if(F.col(column) == c) / F.nullif(n, F.lit(0)) - t) for c, t in targets.items()]
    return report(df, "class_distribution", ~known, row_id, F.greatest(*gaps, F.lit(0.0)), tolerance, lambda v: v <= tolerance + 1e-12, known)


def class_validity(df: DataFrame, row_id: str, column: str, least: float = 0.9) -> DataFrame:
    known = F.col(column).isNotNull()
    return report(df, "perturbation_class_validity", F.col(column) == 0, row_id, rate(F.col(column) == 1, known), least, lambda v: v >= least, known)


def blinding_balance(df: DataFrame, row_id: str, column: str, low: float = 0.45, high: float = 0.55) -> DataFrame:
    return report(df, "blinding_balance", F.lit(False), row_id, rate(F.col(column)), low, lambda v: v.between(low, high))


def length_preservation(df: DataFrame, row_id: str, before: str, after: str, kind: str, exempt: tuple[str, ...] = ("skipped_prerequisite",)) -> DataFrame:
    checked = ~F.coalesce(F.col(kind).isin(*exempt), F.lit(False)) & F.col(before).isNotNull() & F.col(after).isNotNull()
    bad = checked & (F.col(before) != F.col(after))
    return report(df, "length_preservation", bad, row_id, F.count_if(bad), 0, lambda v: v == 0, checked)


def outcome_variance(df: DataFrame, row_id: str, column: str, least: float = 0.1) -> DataFrame:
    known = F.col(column).isNotNull()
    out = report(df, "outcome_variance", F.lit(False), row_id, F.stddev_samp(column), least, lambda v: v >= least, known)
    return out.withColumn("status", F.when(F.col("checked") < 2, "skip").otherwise(F.col("status")))


def step_bounds(df: DataFrame, row_id: str, column: str, low: int | None = 3, high: int | None = None) -> DataFrame:
    """min_steps (``low``) or max_steps (``high``)."""
    bad = F.col(column) < low if high is None else F.col(column) > high
    name, bound = ("min_steps", low) if high is None else ("max_steps", high)
    return report(df, name, bad, row_id, F.count_if(F.coalesce(bad, F.lit(False))), bound, lambda v: v == 0)


def task_success(df: DataFrame, row_id: str, column: str, least: float = 0.0) -> DataFrame:
    return report(df, "task_success", ~F.col(column), row_id, rate(F.col(column)), least, lambda v: v >= least)


def unique_ids(df: DataFrame, row_id: str) -> DataFrame:
    """As many distinct ids as rows with one."""
    known = F.coalesce(F.col(row_id).cast("string"), F.lit("")) != ""
    again = df.filter(known).groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    return report(again, "unique_ids", F.col("n") > 1, row_id, F.sum(F.col("n") - 1), 0, lambda v: v == 0)


def _set_of(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def placebo_semantics(df: DataFrame, row_id: str, before: str, after: str, kind: str) -> DataFrame:
    """Placebos must keep numbers, paths and, within half, their length; a breach is a warning."""
    a, b = F.col(before), F.col(after)
    same = lambda p: _set_of(a, p) == _set_of(b, p)
    length = F.length(b) / F.nullif(F.length(a), F.lit(0))
    keeps = same(r"\b\d+\.?\d*\b") & same(r"[/\\][\w./\\-]+") & F.coalesce(length.between(0.5, 1.5), F.lit(True))
    placebo = F.col(kind) == "placebo"
    return report(df, "placebo_preserves_semantics", placebo & ~keeps, row_id, F.count_if(F.coalesce(placebo & ~keeps, F.lit(False))), 0, lambda v: v == 0, placebo, warn=True)


def meaningful_change(df: DataFrame, row_id: str, before: str, after: str, kind: str) -> DataFrame:
    real = F.col(kind) != "placebo"
    bad = real & F.col(before).cast("string").eqNullSafe(F.col(after).cast("string"))
    return report(df, "non_placebo_meaningful", bad, row_id, F.count_if(F.coalesce(bad, F.lit(False))), 0, lambda v: v == 0, real)


def prompt_gates(df: DataFrame, row_id: str, prompt: str) -> DataFrame:
    """Priming, blinding leaks, complete error vocabulary, valid JSON examples and neutrality of prompts."""
    p = F.col(prompt)
    any_of = lambda patterns: F.coalesce(p.rlike("(?i)" + "|".join(patterns)), F.lit(False))
    missing = F.size(F.array_compact(F.array(*[F.when(~F.contains(F.lower(p), F.lit(w)), w) for w in VOCABULARY])))
    examples = F.regexp_extract_all(p, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    broken = F.exists(examples, lambda x: F.try_parse_json(F.regexp_replace(x, r"\{\{[^}]*\}\}", "0")).isNull())
    praise = lambda side: F.regexp_count(F.lower(p), F.lit(rf"trajectory.?{side}.{{0,20}}(correct|good|better|proper)"))
    parts = {"no_priming": any_of(PRIMING), "no_blinding_leak": any_of(LEAKS), "vocabulary": missing > 0, "json_examples": broken, "neutrality": praise("a") != praise("b")}
    return reduce(DataFrame.unionByName, [report(df, name, bad, row_id, F.count_if(F.coalesce(bad, F.lit(False))), 0, lambda v: v == 0) for name, bad in parts.items()])


def output_parsability(df: DataFrame, row_id: str, output: str, least: float = 0.95) -> DataFrame:
    return report(df, "output_parsability", ~parses(F.col(output)), row_id, rate(parses(F.col(output))), least, lambda v: v >= least)


def run_phase(phase: str, gates: list) -> DataFrame:
    """One report of a phase's gates, given as functions of no argument; one that raises, when planned or run, fails and the others go on."""
    rows, failed = [], []
    for gate in gates:
        try:
            row = gate()
            made = row.collect()  # a report's few rows
            rows.append(row.sparkSession.createDataFrame(made, row.schema))
        except Exception as error:  # a gate's failure is a result
            failed.append((getattr(gate, "__name__", str(gate)), str(error).split("\n")[0]))
    spark = SparkSession.getActiveSession()
    report_ = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], REPORT)
    for name, error in failed:
        one = spark.range(1).select(F.lit(name).alias("gate"), F.lit("fail").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("checked"), F.lit(0).cast("bigint").alias("violations"), F.array(F.lit(error)).alias("examples"))
        report_ = report_.unionByName(one)
    return report_.select(F.lit(phase).alias("phase"), "*")


GATES = {
    f.__name__: f
    for f in (
        trajectory_count, grader_pass_rate, no_synthetic_markers, no_structural_corruption, json_validity, position_distribution, class_distribution, class_validity,
        blinding_balance, length_preservation, outcome_variance, step_bounds, task_success, unique_ids, placebo_semantics, meaningful_change, prompt_gates, output_parsability,
    )
}


def gate(name: str):
    """A gate by name; KeyError if there is none."""
    return GATES[name]
