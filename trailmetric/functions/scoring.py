"""Scalar scoring rules as Column expressions: outcome degradation, impact levels, tiers, evaluation of one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A judge's error type and the perturbation family it stands for.
TYPE_TO_FAMILY = {"planning": "structural", "tool_selection": "tool_selection", "parameter": "parameter", "data_reference": "data_reference"}
OUTCOME_NEUTRAL = 0.5


def strip(text: Column) -> Column:
    """Without white space at the ends, line breaks and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def outcome_degradation(baseline: Column, perturbed: Column) -> Column:
    return baseline - perturbed


def binary_degradation(baseline: Column, perturbed: Column) -> Column:
    """-1, 0 or 1 from two success flags; null if either is unknown."""
    return baseline.cast("int") - perturbed.cast("int")


def baseline_outcome(success: Column) -> Column:
    """Three-valued success as 1.0, 0.0 or, where unknown, 0.5."""
    return F.when(success, 1.0).when(~success, 0.0).otherwise(OUTCOME_NEUTRAL)


def impact_level_signed(od: Column) -> Column:
    """Impact 0-3; only exactly 0 is no impact, so a negative value is minor."""
    return F.when(od == 0, 0).when(od <= 0.25, 1).when(od <= 0.5, 2).when(od.isNotNull(), 3)


def impact_level(od: Column) -> Column:
    """Impact 0-3; negative values are no impact and null stays null."""
    return F.when(od <= 0, 0).when(od <= 0.25, 1).when(od <= 0.5, 2).when(od.isNotNull(), 3)


def degradation_category(od: Column) -> Column:
    return F.when(od < 0, "negative").when(od == 0, "none").when(od <= 0.25, "minor").when(od <= 0.5, "moderate").when(od.isNotNull(), "critical")


def expected_versus_true(true_impact: Column, expected: Column) -> Column:
    return F.when(true_impact == expected, "accurate").when(true_impact > expected, "underestimated").when(true_impact < expected, "overestimated")


def score_tier(score: Column) -> Column:
    return F.when(score <= 0.25, 0).when(score <= 0.5, 1).when(score <= 0.75, 2).when(score.isNotNull(), 3)


def proxy_tier(score: Column) -> Column:
    return F.when(score < 1, F.floor(score * 3).cast("int")).otherwise(3)


def type_family(error_type: Column) -> Column:
    """The family a predicted type maps to; null for others."""
    mapping = F.create_map(*[F.lit(x) for pair in TYPE_TO_FAMILY.items() for x in pair])
    return F.try_element_at(mapping, F.lower(error_type))


def human_type_matches(human_type: Column, family: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in TYPE_TO_FAMILY.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, human_type) == family, F.lit(False))


def position_of(step: Column, steps: Column) -> Column:
    """0-based place of a step id in an array; of repeated ids the last; null if absent."""
    at = F.array_position(F.reverse(steps), step)
    return F.when(at > 0, F.size(steps) - at)


def localization_distance(predicted: Column, target: Column, steps: Column) -> Column:
    return F.abs(position_of(predicted, steps) - position_of(target, steps))


def localization_class(human: Column, truth: Column, steps: Column) -> Column:
    """exact, near (one step away) or wrong; wrong too where either is missing."""
    return F.when(human == truth, "exact").when(localization_distance(human, truth, steps) <= 1, "near").otherwise("wrong")


def propagation(baseline: Column, perturbed: Column, start: Column) -> Column:
    """struct(depth, divergent, convergent positions) of two arrays of step outputs from 0-based ``start``.

    Texts differ if they do so trimmed and in lower case; steps beyond the baseline's end are divergent.
    """
    n = F.least(F.size(baseline), F.size(perturbed))
    norm = lambda x: F.lower(strip(x))
    places = F.when(n > start, F.sequence(start, n - 1)).otherwise(F.array().cast("array<int>"))
    differs = lambda i: ~norm(F.get(baseline, i)).eqNullSafe(norm(F.get(perturbed, i)))
    tail = F.when(F.size(perturbed) > n, F.sequence(n, F.size(perturbed) - 1)).otherwise(F.array().cast("array<int>"))
    divergent = F.concat(F.filter(places, differs), tail)
    return F.struct(F.size(divergent).alias("depth"), divergent.alias("divergent"), F.filter(places, lambda i: ~differs(i)).alias("convergent"))


#: Where a step's output is looked for, in order, and how far numbers may be apart.
OUTPUT_FIELDS, NUMBER_TOLERANCE = ("observation", "extracted_value", "tool_output", "content"), 0.001


def step_output(step_json: Column) -> Column:
    """The first of the output fields that a step (JSON) has, as a variant, also if it is null there."""
    v = F.try_parse_json(step_json)
    return F.coalesce(*[F.try_variant_get(v, f"$.{name}", "variant") for name in OUTPUT_FIELDS])


def outputs_differ(a: Column, b: Column) -> Column:
    """Whether two outputs (variants) differ: texts trimmed and in lower case, numbers by more than the tolerance, others as JSON."""
    none = lambda x: x.isNull() | F.coalesce(F.is_variant_null(x), F.lit(False))
    kind = lambda x: F.schema_of_variant(x)
    text = lambda x: F.lower(strip(F.try_variant_get(x, "$", "string")))
    number = lambda x: F.when(kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(x, "$", "double"))
    out = F.when(none(a) & none(b), False).when(none(a) | none(b), True).when((kind(a) == "STRING") & (kind(b) == "STRING"), text(a) != text(b))
    return out.when(number(a).isNotNull() & number(b).isNotNull(), F.abs(number(a) - number(b)) > NUMBER_TOLERANCE).otherwise(F.to_json(a) != F.to_json(b))


#: Step types that are tool calls, and phrases of a retry.
CALL_TYPES = ("tool_call", "tool_use", "action")
RETRY_PHRASES = ("retry", "try again", "error", "failed", "let me try")


def tool_calls(steps: Column) -> Column:
    """Calls counted by type and again by name, as a step with both counts twice."""
    by_type = lambda s: F.coalesce(s["step_type"].isin(*CALL_TYPES), F.lit(False)).cast("int")
    by_name = lambda s: (F.coalesce(s["tool_name"], F.lit("")) != "").cast("int")
    return F.aggregate(steps, F.lit(0), lambda acc, s: acc + by_type(s) + by_name(s))


def retries(steps: Column) -> Column:
    pattern = "|".join(RETRY_PHRASES)
    return F.size(F.filter(steps, lambda s: F.lower(F.coalesce(s["content"], F.lit(""))).rlike(pattern)))


def recovery_cost(baseline: Column, perturbed: Column, baseline_outcome_: Column, perturbed_outcome: Column) -> Column:
    return F.struct(
        (F.size(perturbed) - F.size(baseline)).alias("extra_steps"),
        (tool_calls(perturbed) - tool_calls(baseline)).alias("extra_tool_calls"),
        (retries(perturbed) - retries(baseline)).alias("retries"),
        baseline_outcome_.eqNullSafe(perturbed_outcome).alias("recovery_successful"),
    )


def evaluate_detection(df: DataFrame) -> DataFrame:
    """Adds is_tp, is_fp, is_tn, is_fn, detection_correct, localization_*, type_correct and is_critical_detected."""
    placebo, detected = F.col("perturbation_class") == "placebo", F.coalesce(F.col("error_detected"), F.lit(False))
    hit = detected & ~placebo
    both = hit & (F.coalesce("predicted_step", F.lit("")) != "") & (F.coalesce("target_step", F.lit("")) != "")
    distance = localization_distance(F.col("predicted_step"), F.col("target_step"), F.col("step_ids"))
    guess = F.lower("predicted_error_type")
    named = hit & (F.coalesce(guess, F.lit("")) != "")
    direct = (guess == F.lower("perturbation_type")) | (guess == F.lower("perturbation_family"))
    matches = F.coalesce(direct, F.lit(False)) | F.coalesce(type_family(guess) == F.lower("perturbation_family"), F.lit(False))
    return df.withColumns(
        {
            "is_tp": hit,
            "is_fp": detected & placebo,
            "is_tn": ~detected & placebo,
            "is_fn": ~detected & ~placebo,
            "detection_correct": hit | (~detected & placebo),
            "localization_correct": F.when(both, F.col("predicted_step") == F.col("target_step")),
            "localization_distance": F.when(both, distance),
            "localization_near": F.when(both, distance <= 1),
            "type_correct": F.when(named, matches),
            "is_critical_detected": F.when(F.col("expected_impact") == 3, detected),
        }
    )


def evaluate_calibration(df: DataFrame) -> DataFrame:
    """Adds cce, abs_cce, over_reaction, under_reaction, failure_*, impact_tier_predicted and impact_tier_error."""
    score, level = F.col("predicted_impact"), F.col("true_impact_level")
    cce = score - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("outcome_degradation")))
    cce = F.when(F.col("outcome_degradation").isNotNull(), cce)
    predicted, actual = F.col("predicted_failure_prob") > 0.5, ~F.col("perturbed_success")
    return df.withColumns(
        {
            "cce": cce,
            "abs_cce": F.abs(cce),
            "over_reaction": F.when(level.isNotNull(), (score > 0.5) & (level <= 1)),
            "under_reaction": F.when(level.isNotNull(), (score < 0.5) & (level == 3)),
            "failure_predicted": predicted,
            "failure_actual": actual,
            "failure_correct": predicted == actual,
            "impact_tier_predicted": score_tier(score),
            "impact_tier_error": F.abs(score_tier(score) - level),
        }
    )


def compare_to_human(df: DataFrame) -> DataFrame:
    """Adds agreement with the human label; the judge's type is mapped to its family, the human's is taken as it is."""
    both = F.col("error_detected") & F.col("human_error_detected")
    return df.withColumns(
        {
            "detection_agrees": F.col("error_detected") == F.col("human_error_detected"),
            "localization_agrees": F.when(both, F.col("predicted_step") == F.col("human_error_step")),
            "type_agrees": F.when(
                F.col("human_error_type").isNotNull() & F.col("predicted_error_type").isNotNull(),
                F.coalesce(type_family(F.col("predicted_error_type")) == F.col("human_error_type"), F.lit(False)),
            ),
            "impact_tier_diff": score_tier(F.col("predicted_impact")) - F.col("human_impact_tier"),
        }
    )


def interpretation(spearman: Column, ece: Column) -> Column:
    """Band of a calibration result: strong, moderate, poor or mixed."""
    return (
        F.when((spearman > 0.5) & (ece < 0.1), "strong")
        .when(spearman.between(0.2, 0.5) & ece.between(0.1, 0.3), "moderate")
        .when((spearman < 0.15) | (ece > 0.3), "poor")
        .otherwise("mixed")
    )


def tcs(degraded: Column, errors: Column) -> Column:
    """True criticality: 100 for a degraded success and 10 for each subsequent error."""
    return degraded * 100 + errors * 10


def ccg(jps: Column, criticality: Column, capped: bool = True) -> Column:
    """Calibration gap (penalty - criticality) / criticality; null at 0. Criticality counts up to 100 unless ``capped`` is off."""
    top = F.least(criticality, F.lit(100.0)) if capped else criticality
    return (jps - top) / F.nullif(top, F.lit(0.0))


def impact_from_criticality(criticality: Column, affects: Column, recoverable: Column, kind: Column) -> Column:
    """Impact 0-3 by quarters of criticality (0.5 if unknown), one more if the answer is affected, one less if recoverable (or not known to be not); placebos 0, coarse ones 2 at least."""
    c = F.coalesce(criticality, F.lit(0.5))
    band = F.when(c < 0.25, 0).when(c < 0.5, 1).when(c < 0.75, 2).otherwise(3)
    up = F.least(F.lit(3), band + F.coalesce(affects, F.lit(False)).cast("int"))
    down = F.greatest(F.lit(0), up - F.coalesce(recoverable, F.lit(True)).cast("int"))
    return F.when(kind == "placebo", 0).when(kind == "coarse_grained", F.greatest(down, F.lit(2))).otherwise(down)
