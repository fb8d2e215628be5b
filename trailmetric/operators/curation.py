"""Trajectory curation: quality metrics, filter cascades with reasons, step cleaning, dataset assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, api_error, final_answer, heuristic_score, strip

#: Fixed values.
HTTP_ERRORS = ("403", "500", "503")
PLACEHOLDERS = ("Country 1", "Capital 1", "placeholder", "N/A", "TBD")
APOLOGIES = (
    "please try again", "try again later", "unable to", "could not", "sorry", "apologize", "cannot provide", "no results",
    "failed to", "error occurred", "not available", "unavailable",
)
BAD_ANSWERS = (
    "[news articles]", "[image link]", "[link]", "country 1", "capital 1", "currency 1", "time zone 1", "please try again later", "i couldn't retrieve",
    "i could not retrieve", "unable to retrieve", "couldn't find", "could not find", "no data associated", "sorry! no data", "currently unavailable", "not available at the moment",
)
THRESHOLDS = {
    "max_http_error_rate": 0.5, "max_thought_none": 2, "max_empty_content_rate": 0.2, "max_missing_tool_input_rate": 0.5, "reject_placeholder_answers": True,
    "reject_null_outcomes": True, "require_finish_step": True, "reject_combined_errors": True, "min_grounding_score": 0.3, "reject_graceful_failures": True, "use_strict_filter": True,
}


def _some(c: Column) -> Column:
    """A text that is there and not empty (nor an empty JSON object or list)."""
    return ~F.coalesce(strip(c), F.lit("")).isin("", "{}", "[]")


def quality_metrics(steps: Column, answer: Column, success: Column) -> dict[str, Column]:
    """The nine metrics of a trajectory as Columns over its array of steps: no explode, no shuffle."""
    n, tools = F.size(steps), F.filter(steps, lambda s: F.coalesce(s["tool_name"], F.lit("")) != "")
    count = lambda of, cond: F.size(F.filter(of, lambda s: F.coalesce(cond(s), F.lit(False))))
    rate = lambda k, of: F.coalesce(k / F.nullif(of, F.lit(0)), F.lit(0.0))
    text = F.coalesce(answer, F.lit(""))
    return {
        "http_error_rate": rate(count(steps, lambda s: any_of(s["tool_output"], HTTP_ERRORS)), n),
        "thought_none_count": count(steps, lambda s: F.contains(s["content"], F.lit("Thought: None"))),
        "empty_content_rate": rate(count(steps, lambda s: F.length(strip(F.coalesce(s["content"], F.lit("")))) < 5), n),
        "missing_tool_input_rate": rate(count(tools, lambda s: ~_some(s["tool_input"])), F.size(tools)),
        "has_placeholder_answer": (n > 0) & any_of(text, PLACEHOLDERS),
        "has_null_outcome": (n == 0) | (strip(text) == "") | success.isNull(),
        "has_finish_step": F.coalesce(F.exists(steps, lambda s: F.coalesce(s["tool_name"] == "Finish", F.lit(False))), F.lit(False)),
        "grounding_score": rate(count(tools, lambda s: _some(s["tool_input"]) | (F.coalesce(s["tool_output"], F.lit("")) != "")), F.size(tools)),
        "is_graceful_failure": F.coalesce((n > 0) & success & any_of(F.lower(text), APOLOGIES), F.lit(False)),
    }


def strict_reason(steps: Column, success: Column) -> Column:
    """Why a trajectory fails the strict rule (an answered, grounded, successful one), or null."""
    last = F.try_element_at(steps, F.lit(-1))
    given = F.try_parse_json(last["tool_input"])
    kind, answer = F.try_variant_get(given, "$.return_type", "string"), strip(F.coalesce(F.try_variant_get(given, "$.final_answer", "string"), F.lit("")))
    real = F.exists(steps, lambda s: ~F.coalesce(s["tool_name"] == "Finish", F.lit(False)) & ~F.coalesce(s["tool_output"], F.lit("")).isin("", "{}", "[]"))
    out = (
        F.when(~F.coalesce(success, F.lit(False)), "task_success_not_true")
        .when(F.size(steps) == 0, "no_steps")
        .when(~F.coalesce(last["tool_name"] == "Finish", F.lit(False)), "final_not_finish")
        .when(~F.coalesce(kind == "give_answer", F.lit(False)), F.concat(F.lit("return_type_not_give_answer:"), F.coalesce(kind, F.lit("None"))))
        .when(answer == "", "empty_final_answer")
        .when(~real, "no_real_tool_output")
    )
    for pattern in BAD_ANSWERS:
        out = out.when(F.contains(F.lower(answer), F.lit(pattern)), f"bad_pattern:{pattern}")
    return F.concat(F.lit("toolbench_strict:"), out)


def reject_reason(df: DataFrame, benchmark: str, thresholds: dict | None = None, enabled: bool = False) -> DataFrame:
    """Adds ``reject_reason``: the first rule that a trajectory breaks, with its figures, or null. Off unless ``enabled``."""
    if not enabled:
        return df.withColumn("reject_reason", F.lit(None).cast("string"))
    t = {**THRESHOLDS, **(thresholds or {})}
    m = quality_metrics(F.col("steps"), F.col("ground_truth.expected_answer"), F.col("ground_truth.task_success"))
    named = df.withColumns({f"_{k}": v for k, v in m.items()})
    c = lambda k: F.col(f"_{k}")
    over = lambda k, limit, sign=">": F.format_string(f"{k}:%.2f{sign}{limit}", c(k))
    strict = strict_reason(F.col("steps"), F.col("ground_truth.task_success")) if benchmark == "toolbench" and t["use_strict_filter"] else F.lit(None).cast("string")
    out = F.when(strict.isNotNull(), strict)
    out = out.when(c("http_error_rate") > t["max_http_error_rate"], over("http_error_rate", t["max_http_error_rate"]))
    out = out.when(c("thought_none_count") >= t["max_thought_none"], F.format_string(f"thought_none_count:%d>={t['max_thought_none']}", c("thought_none_count")))
    out = out.when(c("empty_content_rate") > t["max_empty_content_rate"], over("empty_content_rate", t["max_empty_content_rate"]))
    out = out.when(c("missing_tool_input_rate") > t["max_missing_tool_input_rate"], over("missing_tool_input_rate", t["max_missing_tool_input_rate"]))
    if t["reject_placeholder_answers"]:
        out = out.when(c("has_placeholder_answer"), "placeholder_answer")
    if t["reject_null_outcomes"]:
        out = out.when(c("has_null_outcome"), "null_outcome")
    if benchmark == "toolbench" and t["require_finish_step"]:
        out = out.when(~c("has_finish_step"), "missing_finish_step")
    if t["reject_combined_errors"]:
        out = out.when((c("http_error_rate") > 0) & (c("thought_none_count") > 0), "combined_errors:http_errors+thought_none")
    if benchmark == "gaia":
        out = out.when(c("grounding_score") < t["min_grounding_score"], over("grounding_score", t["min_grounding_score"], "<").substr(F.lit(1), F.lit(99)))
    if t["reject_graceful_failures"]:
        out = out.when(c("is_graceful_failure"), "graceful_failure:apology_answer_with_success")
    return named.withColumn("reject_reason", F.regexp_replace(out, "^grounding_score:", "low_grounding:")).drop(*[f"_{k}" for k in m])


def step_count_reason(df: DataFrame, low: int, high: int) -> DataFrame:
    n = F.size("steps")
    return df.withColumn("reject_reason", F.when(F.coalesce(n, F.lit(0)) < low, F.format_string(f"too_few_steps:%d<{low}", F.coalesce(n, F.lit(0)))).when(n > high, F.format_string(f"too_many_steps:%d>{high}", n)))


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejection log)."""
    return df.filter("reject_reason is null").drop("reject_reason"), df.filter("reject_reason is not null").select("trajectory_id", "reject_reason")


def rejection_counts(df: DataFrame) -> DataFrame:
    """Rejections by rule, without figures."""
    rule = F.substring_index("reject_reason", ":", 1)
    return df.filter("reject_reason is not null").groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def cleaned_steps(steps: Column) -> Column:
    """Steps of 3 characters or more and not 'Thought: None', tool steps without a tool as reasoning, numbered anew."""
    held = F.filter(steps, lambda s: (F.length(strip(F.coalesce(s["content"], F.lit("")))) >= 3) & ~F.contains(s["content"], F.lit("Thought: None")))
    no_tool = lambda s: (s["step_type"] == "tool_execution") & (F.coalesce(s["tool_name"], F.lit("")) == "")
    retyped = lambda s, i: s.withField("step_number", i + 1).withField("step_type", F.when(F.coalesce(no_tool(s), F.lit(False)), "reasoning").otherwise(s["step_type"]))
    return F.transform(held, retyped)


def with_clean_steps(df: DataFrame) -> DataFrame:
    before = F.size("steps")
    return df.withColumn("steps_before", before).withColumn("steps", cleaned_steps(F.col("steps"))).withColumn("steps_removed", F.col("steps_before") - F.size("steps"))


def position_ranges(n: Column) -> dict[str, tuple[Column, Column]]:
    """First and last step number of the early, middle and late part; short trajectories have parts that overlap."""
    third = F.floor(n / 3).cast("int")
    return {
        "early": (F.lit(1), F.greatest(F.lit(2), third)),
        "middle": (F.when(n <= 3, 2).otherwise(third + 1), F.when(n <= 3, 2).otherwise(third * 2)),
        "late": (F.greatest(n - 1, n - third, F.lit(1)), n),
    }


def parameters_everywhere(steps: Column, extra=None) -> Column:
    """Whether each part of the steps has one, not Finish, with parameters; with ``extra``, one that meets it instead."""
    n = F.size(steps)
    good = lambda s: (F.coalesce(s["tool_name"], F.lit("")) != "Finish") & (_some(s["tool_input"]) if extra is None else extra(s))
    has = lambda low, high: F.exists(steps, lambda s: F.coalesce(s["step_number"].between(low, high) & good(s), F.lit(False)))
    early, middle, late = position_ranges(n).values()
    return F.when(n > 0, has(*early) & has(*middle) & has(*late)).otherwise(False)


def diverse_tools(df: DataFrame, substitutes: DataFrame) -> DataFrame:
    """Rows in each part of whose steps some tool has a substitute; ``substitutes`` (tool, ...) is a catalogue.

    Tools are looked up by a join of those that occur, so the catalogue may be of any size.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id()) if "trajectory_id" not in df.columns else df.withColumn("_row", F.col("trajectory_id"))
    used = rows.select("_row", F.explode("steps.tool_name").alias("tool")).distinct().join(substitutes.select("tool").distinct(), "tool", "left_semi")
    known = used.groupBy("_row").agg(F.collect_set("tool").alias("_known"))  # as many as a trajectory has tools
    return rows.join(known, "_row").filter(parameters_everywhere(F.col("steps"), lambda s: F.array_contains("_known", s["tool_name"]))).select(*df.columns)


def verified_baselines(df: DataFrame, responses: DataFrame, least: float, target: int | None = None) -> DataFrame:
    """Trajectories whose outside check would succeed without an error and scores ``least``; an unread check rejects."""
    v = F.try_parse_json(F.col("response"))
    ok = F.try_variant_get(v, "$.would_succeed", "boolean") & ~F.try_variant_get(v, "$.error_detected", "boolean") & (F.try_variant_get(v, "$.score", "double") >= least)
    good = responses.filter(F.coalesce(ok, F.lit(False))).select("trajectory_id").distinct()
    kept = df.join(good, "trajectory_id", "left_semi")
    return kept if target is None else kept.orderBy("trajectory_id").limit(target)


def first_present(names: list[str], df: DataFrame) -> Column:
    """The first of the columns that the frame has (nested ones by path), also if it is null there; null if it has none."""
    for name in names:
        head, *rest = name.split(".")
        kind = df.schema[head].dataType if head in df.columns else None
        for part in rest:
            kind = kind[part].dataType if kind is not None and hasattr(kind, "names") and part in kind.names else None
        if kind is not None:
            return F.col(name)
    return F.lit(None).cast("string")


#: Step counts that a scan keeps if it isn't told otherwise.
STEP_BOUNDS = {"toolbench": (1, 100), "gaia": (1, 100), "swebench": (4, 30)}
#: Fixed value: the heuristic score from which an answer passes.
PASS_SCORE = 0.5


def grader_aligned(steps: Column, success: Column) -> Column:
    """A success by its own record whose final answer also passes the heuristic grader; one of unknown outcome is none."""
    errors = F.size(F.filter(steps, lambda s: api_error(s["tool_output"])))
    return F.coalesce(success, F.lit(False)) & (heuristic_score(final_answer(steps), errors) >= PASS_SCORE)


def loaded(
    df: DataFrame, benchmark: str, size: int | None = None, low: int | None = None, high: int | None = None, success: bool = False, aligned: bool = False, difficulty: str | None = None, coverage: bool = False,
    substitutes: DataFrame | None = None, quality: dict | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(sample, rejections) of parsed trajectories: step counts, outcome, difficulty, coverage, tools with substitutes, quality rules if given, then a seeded sample.

    ``success`` rejects what is known to have failed, so an unknown outcome stays; ``aligned`` wants a success that the
    grader sees too, and then ``success`` says nothing more. A rejected trajectory is logged with the first rule that it
    breaks; the sample is the first ``size`` by the hash of seed and id.
    """
    from .sampling import shuffled_head

    least, most = STEP_BOUNDS[benchmark]
    low, high = least if low is None else low, most if high is None else high
    n, outcome = F.size("steps"), F.col("ground_truth.task_success")
    rule = F.when(n < low, F.format_string("too_few_steps:%d", n)).when(n > high, F.format_string("too_many_steps:%d", n))
    if aligned:
        rule = rule.when(~grader_aligned(F.col("steps"), outcome), "grader_aligned")
    elif success:
        rule = rule.when(F.coalesce(~outcome, F.lit(False)), "task_success")
    if difficulty is not None:
        rule = rule.when(~F.coalesce(F.col("ground_truth.difficulty") == difficulty, F.lit(False)), "difficulty")
    if coverage:
        rule = rule.when(~F.coalesce(parameters_everywhere(F.col("steps")), F.lit(False)), "parameter_coverage")
    columns = df.columns
    if substitutes is not None:
        diverse = diverse_tools(df, substitutes).select("trajectory_id").distinct().withColumn("_diverse", F.lit(True))
        df = df.join(diverse, "trajectory_id", "left")
        rule = rule.when(F.col("_diverse").isNull(), "tool_diversity")
    marked = reject_reason(df, benchmark, quality, enabled=quality is not None)
    marked = marked.withColumn("reject_reason", F.coalesce(rule, "reject_reason")).select(*columns, "reject_reason")
    kept, log = split_rejected(marked)
    return kept if size is None else shuffled_head(kept, "trajectory_id", size, seed), log
