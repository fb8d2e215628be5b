"""Human labels: votes, aggregation per unit, annotator quality control, runs, gold accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import pooled_alphas

LOW_AGREEMENT = 0.6


def majority(df: DataFrame, unit: str, value: str, order: str, name: str) -> DataFrame:
    """unit, <name>_majority and <name>_agreement (1.0 for a single vote). Ties go to the value seen first by ``order``."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    best = votes.groupBy(unit).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "f")).alias(f"{name}_majority"), F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.select(unit, f"{name}_majority", F.when(F.col("t") < 2, 1.0).otherwise(F.col("m") / F.col("t")).alias(f"{name}_agreement"))


def localization_agreement(df: DataFrame, unit: str, step: str) -> DataFrame:
    """exact if all named steps are one, else mixed; null without any."""
    n = F.count_distinct(step)
    return df.groupBy(unit).agg(F.when(n == 1, "exact").when(n > 1, "mixed").alias("localization_agreement"))


def aggregate_labels(annotations: DataFrame, low: float = LOW_AGREEMENT) -> DataFrame:
    """One row per unit from flat annotations.

    Columns in: unit_id, annotator_id, annotation_id, seq, error_detected, error_trajectory, error_step_id,
    confidence, error_type, impact_tier, propagation_depth, preference.
    """
    base = annotations.groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "annotation_id"))).alias("_ids"),  # as long as a unit has annotations
        F.count_distinct("annotator_id").alias("num_annotators"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("impact_tier").alias("mean_impact_tier"),
        F.stddev_pop("impact_tier").alias("impact_tier_std"),
        F.avg("propagation_depth").alias("mean_propagation_depth"),
    )
    out = base.select("unit_id", F.col("_ids.annotation_id").alias("annotation_ids"), *[c for c in base.columns if c not in ("unit_id", "_ids")])
    for column, name in (("error_detected", "detected"), ("error_trajectory", "trajectory"), ("error_step_id", "step"), ("error_type", "type"), ("preference", "preference")):
        out = out.join(majority(annotations, "unit_id", column, "seq", name), "unit_id", "left")
    out = out.join(localization_agreement(annotations, "unit_id", "error_step_id"), "unit_id", "left")
    below = lambda c: F.coalesce(F.col(c) < low, F.lit(False))
    split = below("detected_agreement") | below("trajectory_agreement")
    return out.withColumns({"low_agreement_flag": split | below("preference_agreement"), "needs_adjudication": split})


def aggregation_summary(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if("low_agreement_flag").alias("low_agreement"),
        F.count_if("needs_adjudication").alias("adjudication"),
        F.avg("detected_agreement").alias("mean_detected_agreement"),
        F.avg("type_agreement").alias("mean_type_agreement"),
        F.avg("num_annotators").alias("mean_annotators"),
    )


def majority_distributions(labels: DataFrame, names: tuple[str, ...] = ("detected", "trajectory", "preference")) -> DataFrame:
    """dimension, value (as text), units whose majority it is, their share and mean agreement, one pass for all dimensions; units without a vote are left out."""
    said = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_majority").cast("string").alias("value"), F.col(f"{n}_agreement").alias("a")) for n in names])
    per = labels.select(F.explode(said).alias("s")).select("s.*").filter("value IS NOT NULL").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("units"), F.avg("a").alias("mean_agreement"))
    whole = per.groupBy("dimension").agg(F.sum("units").alias("_all"))  # one row a dimension
    return per.join(whole, "dimension").select("dimension", "value", "units", (F.col("units") / F.col("_all")).alias("share"), "mean_agreement")


def runs(df: DataFrame, annotator: str, value: str, order: list[Column], threshold: int = 5) -> DataFrame:
    """annotator, longest run of one value, and whether it reaches the threshold; a null ends a run. Order is total per annotator."""
    by = Window.partitionBy(annotator).orderBy(*order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(by)), F.lit(True)) | F.col(value).isNull()
    marked = df.withColumn("_change", changed.cast("int")).withColumn("_island", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = marked.filter(F.col(value).isNotNull()).groupBy(annotator, "_island").agg(F.count(F.lit(1)).alias("n"))
    return islands.groupBy(annotator).agg(F.max("n").alias("longest_run"), (F.max("n") >= threshold).alias("flagged"))


def flagged_runs(df: DataFrame, annotator: str, value: str, order: list[Column], threshold: int = 5) -> DataFrame:
    """annotator, start and end (0-based) and value of each run that reaches the threshold; ``length`` is the threshold."""
    by = Window.partitionBy(annotator).orderBy(*order)
    changed = F.coalesce((F.col(value) != F.lag(value).over(by)), F.lit(True)) | F.col(value).isNull()
    marked = df.withColumn("_at", F.row_number().over(by) - 1).withColumn("_change", changed.cast("int"))
    marked = marked.withColumn("_island", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col(value).isNotNull())
    found = marked.groupBy(annotator, "_island").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.first(value).alias("value"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= threshold).select(annotator, "start", "end", "value", F.lit(threshold).alias("length"))


def time_bounds(df: DataFrame, low: float, high: float, by: str | None = None) -> DataFrame:
    t = F.col("time_spent_seconds")
    aggs = [F.count(t).alias("n"), F.count_if(t < low).alias("fast"), F.count_if(t > high).alias("slow"), F.count_if(t.between(low, high)).alias("passed"), F.avg(t).alias("mean_time"), F.median(t).alias("median_time")]
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def gold_accuracy(annotations: DataFrame, gold: DataFrame, annotator: str, unit: str, fields: list[str]) -> DataFrame:
    """annotator, compared, correct, accuracy, status over gold units; null equals null; no overlap says so."""
    names = {f: f"gold_{f}" for f in fields}
    joined = annotations.join(gold.select(unit, *[F.col(f).alias(g) for f, g in names.items()]), unit)
    hits = sum((F.col(f).eqNullSafe(F.col(g)).cast("int") for f, g in names.items()), F.lit(0))
    per = joined.groupBy(annotator).agg((F.count(F.lit(1)) * len(fields)).alias("compared"), F.sum(hits).alias("correct"))
    all_ = annotations.select(annotator).distinct().join(per, annotator, "left")
    accuracy = F.col("correct") / F.col("compared")
    status = F.when(accuracy.isNull(), "no_gold_overlap").when(accuracy >= 0.8, "passing").when(accuracy >= 0.7, "warning").otherwise("recalibrate")
    return all_.select(annotator, F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce("correct", F.lit(0)).alias("correct"), accuracy.alias("accuracy"), status.alias("status"))


def annotator_quality(issue_rate: Column, flagged: Column, gold: Column) -> Column:
    """1 - 0.3 * issues - 0.2 if flagged, blended 0.7 : 0.3 with gold accuracy where there is one, held in [0, 1]."""
    own = 1 - 0.3 * issue_rate - 0.2 * flagged.cast("int")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(gold.isNotNull(), 0.7 * own + 0.3 * gold).otherwise(own)))


#: Dimension -> (level, threshold).
DIMENSIONS = {
    "error_detected": ("nominal", 0.6), "error_trajectory": ("nominal", 0.6), "error_step_id": ("nominal", 0.6), "confidence": ("ordinal", 0.4),
    "error_type": ("nominal", 0.6), "impact_tier": ("ordinal", 0.4), "preference": ("nominal", 0.6),
}


def agreement_report(annotations: DataFrame, dimensions: dict[str, tuple[str, float]] = DIMENSIONS) -> DataFrame:
    """dimension, alpha, threshold, met; ``acceptable`` if four in five of those with an alpha are met, or there is none."""
    known = {d: kind for d, kind in dimensions.items() if d in annotations.columns}
    threshold = F.element_at(F.create_map(*[F.lit(x) for d, (_, t) in known.items() for x in (d, float(t))]), F.col("dimension"))
    alphas = pooled_alphas(annotations, "unit_id", {d: level for d, (level, _) in known.items()})
    report = alphas.select("dimension", "alpha", "band", threshold.alias("threshold"), (F.col("alpha") >= threshold).alias("met"))
    share = report.agg(F.avg(F.col("met").cast("int")).alias("s"))
    return report.join(share).withColumn("acceptable", F.coalesce(F.col("s") >= 0.8, F.lit(True))).drop("s")


def annotation_summary(df: DataFrame) -> DataFrame:
    """Degraded successes, errors and criticality over annotations (tsd 0 / 1, ser count)."""
    tcs = F.col("tsd") * 100 + F.col("ser") * 10
    aggs = [f(c).alias(f"{n}_{name}") for c, name in ((F.col("tsd"), "tsd"), (F.col("ser"), "ser"), (tcs, "tcs")) for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))]
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("annotator_id").alias("annotators"), *aggs)


def range_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``: names of values out of range (tsd 0 or 1, ser 0-3, criticality 1-5); null is missing."""
    check = lambda c, low, high: F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), c)
    return df.withColumn("errors", F.array_compact(F.array(check("tsd", 0, 1), check("ser", 0, 3), check("criticality", 1, 5))))
