"""Evaluation units from perturbation records: the baseline is made from the perturbed steps by undoing the record.

Input rows: perturbation_id, source_trajectory_id, benchmark, experiment_id, perturbation_index, a record's fields and
``undo`` (may be null, as in records from elsewhere), perturbed_steps. A row that can't be assembled has ``error`` and
no unit; it never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAPABILITIES, a_is_baseline, baseline_id, perturbed_id, replay_tier, step_id, unit_id
from .structural import STEP, edited, with_slot, with_step


def reverted(perturbed: Column, index: Column, slot: Column, original: Column, new: Column, undo: Column) -> Column:
    """The baseline's steps: a deleted step (JSON) stands at its place again, an inserted one goes, a slot has its value back.

    Steps that a truncation removed come from ``undo``, as do a text or flag beside the slot; without it they stay as they are.
    """
    deleted = (slot == "step") & new.isNull() & original.isNotNull()
    inserted = (slot == "step") & original.isNull() & new.isNotNull()
    back = with_step(perturbed, F.from_json(original, STEP))
    out = F.filter(perturbed, lambda s: s["step_index"] != index)
    cut = F.concat(F.slice(perturbed, F.lit(1), F.size(perturbed) - 1), undo["removed"])

    def beside(s: Column) -> Column:
        return s.withField("raw_text", F.coalesce(undo["raw_text"], s["raw_text"])).withField("produces_final_answer", F.coalesce(undo["produces_final_answer"], s["produces_final_answer"]))

    field = edited(with_slot(perturbed, index, slot, original), index, beside)
    return F.when(deleted, back).when(inserted, out).when((slot == "trajectory_length") & undo["removed"].isNotNull(), cut).otherwise(field)


def identified(steps: Column, source: Column, renumbered: Column | bool = False) -> Column:
    """struct(canonical_step_id, display_step_index, step) of each step: by its own index, or shown by place where a deletion moved them."""
    shown = lambda s, i: F.when(renumbered if isinstance(renumbered, Column) else F.lit(renumbered), i + 1).otherwise(F.coalesce(s["step_index"], i + 1))
    return F.transform(steps, lambda s, i: F.struct(step_id(source, F.coalesce(s["step_index"], i + 1)).alias("canonical_step_id"), shown(s, i).alias("display_step_index"), s.alias("step")))


def _problem() -> Column:
    """Why a row can't be assembled; null if it can."""
    known = F.lower("benchmark").isin(*CAPABILITIES)
    return (
        F.when(F.col("perturbed_steps").isNull(), "no perturbed steps")
        .when(F.col("source_trajectory_id").isNull(), "no source trajectory")
        .when(F.col("target_slot").isNull() | F.col("target_step_index").isNull(), "no target")
        .when(~F.coalesce(known, F.lit(False)), "unknown benchmark")
        .when((F.col("target_slot") == "step") & F.col("original_value").isNotNull() & F.col("perturbed_value").isNull() & F.from_json("original_value", STEP)["step_index"].isNull(), "unreadable step")
        .when((F.col("target_slot") == "trajectory_length") & F.col("undo.removed").isNull(), "removed steps unknown")
    )


def assembled(df: DataFrame, seed: int = 42) -> DataFrame:
    """A row of each record: evaluation_unit_id, variant ids, baseline and perturbed steps with identities, capabilities, replay_tier, derived_cache, blinding, error."""
    source, n = F.col("source_trajectory_id"), F.col("perturbation_index").cast("int")
    rows = df.withColumn("error", _problem())
    good = F.col("error").isNull()
    args = [F.col(c) for c in ("perturbed_steps", "target_step_index", "target_slot", "original_value", "perturbed_value", "undo")]
    rows = rows.withColumn("_baseline", F.when(good, reverted(*args)))
    deletion = (F.col("target_slot") == "step") & F.col("perturbed_value").isNull()
    flags = {name: F.get(F.filter(F.array(*[F.when(F.lower("benchmark") == b, F.lit(f[name])) for b, f in CAPABILITIES.items()]), lambda x: x.isNotNull()), 0) for name in CAPABILITIES["gaia"]}
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    baseline, perturbed = baseline_id(source), perturbed_id(source, n)
    first = a_is_baseline(F.col("evaluation_unit_id"), seed)
    units = rows.withColumn("evaluation_unit_id", F.when(good, unit_id(source, n)))
    if "expected_impact" not in df.columns:
        units = units.withColumn("expected_impact", F.lit(0))
    cache = F.struct(
        F.size("_baseline").alias("baseline_num_steps"), F.size("perturbed_steps").alias("perturbed_num_steps"), text("perturbation_class").alias("perturbation_class"), text("perturbation_family").alias("perturbation_family"),
        text("perturbation_type").alias("perturbation_type"), step_id(source, F.col("target_step_index")).alias("target_step_canonical_id"), F.coalesce("expected_impact", F.lit(0)).cast("int").alias("expected_impact"),
    )
    blinding = F.struct(
        F.when(first, baseline).otherwise(perturbed).alias("trajectory_a_variant_id"), F.when(first, perturbed).otherwise(baseline).alias("trajectory_b_variant_id"), first.alias("is_a_baseline"), (~first).alias("is_a_perturbed")
    )
    whole = {
        "baseline_variant_id": baseline,
        "perturbed_variant_id": perturbed,
        "baseline": identified(F.col("_baseline"), source),
        "perturbed": identified(F.col("perturbed_steps"), source, deletion),
        "capabilities": F.struct(*[v.alias(k) for k, v in flags.items()]),
        "replay_tier": replay_tier(flags["can_replay"], flags["environment_accessible"], flags["has_objective_verifier"], flags["can_regenerate_downstream"], flags["ground_truth_available"]),
        "derived_cache": cache,
        "blinding": blinding,
    }
    return units.withColumns({k: F.when(good, v) for k, v in whole.items()}).drop("_baseline")
