"""Aggregates over the analysis fact table: detection, calibration, CCG, agreement, summaries.

Every function takes and returns DataFrames; rates follow one rule: a stratum without
rows gives null, a zero denominator inside a stratum 0.0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import auc, spearman


def yes(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(0.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return part / F.nullif(whole, F.lit(0))


def detection_aggregates() -> dict[str, Column]:
    real = F.col("perturbation_class") != "placebo"
    tp, fp, tn, fn = (yes(F.col(c)) for c in ("is_tp", "is_fp", "is_tn", "is_fn"))
    n_real, n_placebo, hits = yes(real), yes(~real), yes(real & F.col("error_detected"))
    critical = real & (F.col("expected_impact") == 3)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    of_hits = lambda c: share(yes(real & F.col("error_detected") & F.col(c)), hits)
    return {
        "n_total": F.count(F.lit(1)),
        "pdr": F.when(n_real > 0, recall),
        "pdr_n": n_real,
        "pndr": F.when(n_placebo > 0, ratio(tn, tn + fp)),
        "pndr_n": n_placebo,
        "sla": of_hits("localization_correct"),
        "sla_pm1": of_hits("localization_near"),
        "sla_n": hits,
        "tia": of_hits("type_correct"),
        "cer": share(yes(critical & F.col("is_critical_detected")), yes(critical)),
        "cer_n": yes(critical),
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(0.0),
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
    }


def named(aggregates: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in aggregates.items()]


def detection_metrics(df: DataFrame, with_auc: bool = True) -> DataFrame:
    """One row; detection_auc ranks non-placebos above placebos by confidence."""
    out = df.agg(*named(detection_aggregates()))
    return out.join(auc(df, F.col("perturbation_class") != "placebo", "error_confidence", "detection_auc")) if with_auc else out


def by_strata(df: DataFrame, strata: dict[str, str], aggregates: dict[str, Column]) -> DataFrame:
    """dimension, stratum and the aggregates; a missing value is the stratum 'None'. One pass: each row meets every dimension."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("stratum")) for name, c in strata.items()])
    each = df.withColumn("_at", F.explode(pairs)).withColumns({"dimension": F.col("_at.dimension"), "stratum": F.col("_at.stratum")})
    return each.groupBy("dimension", "stratum").agg(*named(aggregates))


DETECTION_STRATA = {"by_class": "perturbation_class", "by_family": "perturbation_family", "by_detectability": "expected_detectability", "by_impact": "expected_impact", "by_benchmark": "benchmark"}
CALIBRATION_STRATA = {"by_true_impact": "true_impact_level", "by_class": "perturbation_class", "by_family": "perturbation_family", "by_benchmark": "benchmark"}


def detection_by_stratum(df: DataFrame, strata: dict[str, str] = DETECTION_STRATA) -> DataFrame:
    all_ = detection_aggregates()
    return by_strata(df, strata, {"n": all_["n_total"], "pdr": all_["pdr"], "sla": all_["sla"]})


def failure_ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """failure_ece over right-open bins; a probability of 1 is in none but counts in the whole; null under ``bins`` rows."""
    known = df.filter(F.col("failure_actual").isNotNull()).select(F.col("predicted_failure_prob").alias("p"), F.col("failure_actual").cast("int").alias("y"))
    total = known.agg(F.count(F.lit(1)).alias("n_all"))
    at = reduce(lambda acc, i: acc.when((F.col("p") >= i / bins) & (F.col("p") < (i + 1) / bins), i), range(bins), F.when(F.lit(False), -1))
    binned = known.withColumn("bin", at).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    gap = F.sum(F.col("n") / F.col("n_all") * F.abs(F.col("acc") - F.col("conf")))
    out = total.join(binned, how="left").agg(F.max("n_all").alias("n_all"), gap.alias("ece"))
    return out.select(F.when(F.col("n_all") >= bins, F.coalesce("ece", F.lit(0.0))).alias("failure_ece"))


def calibration_metrics(df: DataFrame, with_correlation: bool = True) -> DataFrame:
    level = F.col("true_impact_level")
    low, high = yes(level <= 1), yes(level == 3)
    out = df.agg(
        yes(F.col("outcome_degradation").isNotNull()).alias("ccorr_n"),
        F.avg("cce").alias("mean_cce"),
        F.stddev_pop("cce").alias("std_cce"),
        F.avg("abs_cce").alias("abs_cce"),
        share(yes((level <= 1) & F.col("over_reaction")), low).alias("orr"),
        low.alias("orr_n"),
        share(yes((level == 3) & F.col("under_reaction")), high).alias("urr"),
        high.alias("urr_n"),
        F.avg("impact_tier_error").alias("impact_mae"),
        share(yes(F.col("impact_tier_error") == 0), F.count("impact_tier_error")).alias("impact_tier_exact"),
    )
    if not with_correlation:
        return out
    known = df.filter(F.col("outcome_degradation").isNotNull())
    return out.join(spearman(known, "predicted_impact", "outcome_degradation", name="ccorr").select("ccorr")).join(failure_ece(df))


def calibration_by_stratum(df: DataFrame, strata: dict[str, str] = CALIBRATION_STRATA) -> DataFrame:
    return by_strata(df, strata, {"n": F.count(F.lit(1)), "mean_cce": F.avg("cce"), "abs_cce": F.avg(F.abs("cce"))})


def ece_bins(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, mean_actual, gap for all bins; 1 is in the last, negatives in the first; empty bins have nulls."""
    at = reduce(lambda acc, i: acc.when(F.col(predicted) < (i + 1) / bins, i), range(bins - 1), F.when(F.lit(False), -1)).otherwise(bins - 1)
    found = df.filter(F.col(predicted).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "mean_actual", F.abs(F.col("mean_predicted") - F.col("mean_actual")).alias("gap"))


def expected_calibration_error(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """ece (gaps weighted by bin size) and mce (largest gap)."""
    found = ece_bins(df, predicted, actual, bins).filter("n > 0")
    return found.agg(share(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def proxy_calibration(df: DataFrame) -> DataFrame:
    """Calibration against expected_impact / 3 of the non-placebos; fewer than 3 give no row."""
    p, e = F.col("predicted_impact"), F.col("expected_impact")
    rows = df.filter((F.col("perturbation_class") != "placebo") & e.isNotNull())
    tier = F.when(p < 1, F.floor(p * 3)).otherwise(3)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(p - e / 3.0)).alias("proxy_mae"),
        share(yes(tier == e), F.count(F.lit(1))).alias("proxy_tier_accuracy"),
        share(yes((p > 0.5) & (e <= 1)), yes(e <= 1)).alias("proxy_orr"),
        share(yes((p < 0.5) & (e == 3)), yes(e == 3)).alias("proxy_urr"),
    ).filter("n >= 3")


def human_agreement(df: DataFrame) -> DataFrame:
    """Means of the agreement flags (nulls left out), tier MAE and signed bias."""
    mean = lambda c: F.avg(F.col(c).cast("int"))
    return df.agg(
        mean("detection_agrees").alias("detection_agreement"),
        mean("localization_agrees").alias("localization_agreement"),
        mean("type_agrees").alias("type_agreement"),
        F.avg(F.abs("impact_tier_diff")).alias("tier_mae"),
        F.avg("impact_tier_diff").alias("tier_bias"),
    )


def ccg_rows(df: DataFrame, default_tcs: float = 50.0) -> DataFrame:
    """Adds jps (or 100 - overall_score), tcs (default where missing) and ccg; rows without a score go."""
    from ..functions.scoring import ccg

    scored = df.withColumn("jps", F.coalesce("jps", 100 - F.col("overall_score"))).filter("jps is not null")
    scored = scored.withColumn("tcs", F.coalesce("tcs", F.lit(default_tcs)))
    return scored.withColumn("ccg", ccg(F.col("jps"), F.col("tcs")))


def ccg_exclusions(df: DataFrame) -> DataFrame:
    """Rows with a score, without one, and of zero criticality."""
    from ..functions.scoring import ccg

    jps = F.coalesce("jps", 100 - F.col("overall_score"))
    gap = ccg(jps, F.coalesce("tcs", F.lit(50.0)))
    return df.agg(yes(jps.isNotNull()).alias("total_evaluated"), yes(jps.isNull()).alias("no_score_skipped"), yes(jps.isNotNull() & gap.isNull()).alias("zero_tcs_excluded"), F.count("ccg").alias("valid") if "ccg" in df.columns else F.count(gap).alias("valid"))


def ccg_report(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Overall and per value of each dimension in one pass (grouping sets); rows with a null in a dimension aren't in its groups."""
    c = F.col("ccg")
    flags = sum((F.when(F.grouping(d) == 0, i + 1).otherwise(0) for i, d in enumerate(dimensions)), F.lit(0))
    out = df.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(
        flags.alias("level"), F.count(c).alias("n"), F.avg(c).alias("mean_ccg"), F.stddev_samp(c).alias("std_ccg"), F.min(c).alias("min_ccg"), F.max(c).alias("max_ccg"), F.median(c).alias("median_ccg"), F.avg("jps").alias("mean_jps"), F.avg("tcs").alias("mean_tcs")
    )
    out = out.withColumns({f"v_{d}": F.col(d).cast("string") for d in dimensions})
    names = F.array(F.lit("overall"), *[F.lit(d) for d in dimensions])
    value = reduce(lambda acc, d: acc.when(F.col("level") == dimensions.index(d) + 1, F.col(f"v_{d}")), dimensions, F.when(F.col("level") == 0, ""))
    return out.withColumn("value", value).filter("value is not null").select(F.element_at(names, F.col("level") + 1).alias("dimension"), "value", "n", "mean_ccg", "std_ccg", "min_ccg", "max_ccg", "median_ccg", "mean_jps", "mean_tcs")


def spreads(df: DataFrame, by: str, value: str) -> DataFrame:
    """The three conventions side by side: sample (null for one row), population, and sample with 0 for one row."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std_sample"), F.stddev_pop(value).alias("std_population"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_or_zero"))


def detection_table(df: DataFrame) -> DataFrame:
    """Detected percent by version and class for three populations: all, class-validated and clean baselines."""
    populations = F.array(
        F.lit("all"),
        F.when(F.coalesce("class_matches", F.lit(1)) == 1, "class_validated"),
        F.when(F.coalesce("clean_baseline", F.lit(True)), "clean_baseline"),
    )
    each = df.withColumn("population", F.explode(F.array_compact(populations)))
    return each.groupBy("version", "population", "perturbation_class").agg(
        F.count(F.lit(1)).alias("total"), yes(F.col("error_detected")).alias("detected"), (100.0 * yes(F.col("error_detected")) / F.count(F.lit(1))).alias("rate")
    )


def judge_samples(df: DataFrame) -> DataFrame:
    """Per unit and judge over its samples: means and sample deviations (0 for one sample) of score, confidence, impact and failure, detected rate, modal step and type.

    Steps and types count from samples that detect an error; a tie goes to the one seen first by sample number. Without any
    the mode is null and its share 0.
    """
    by = ["unit_id", "judge_model"]
    hits = df.filter("error_detected")

    def modal(column: str, name: str) -> DataFrame:
        votes = hits.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("seen"))
        return votes.groupBy(*by).agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), "seen", column)).alias(f"modal_{name}"), (F.max("n") / F.sum("n")).alias(f"{name}_agreement"))

    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    measures = [("overall_score", "score"), ("error_confidence", "confidence"), ("predicted_impact", "impact"), ("predicted_failure_prob", "failure")]
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col("error_detected").cast("int")).alias("detected_rate"),
        *[f for c, name in measures for f in (F.avg(c).alias(f"mean_{name}"), spread(c).alias(f"std_{name}"))],
    )
    out = stats.join(modal("predicted_step", "step"), by, "left").join(modal("predicted_error_type", "type"), by, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("step_agreement", "type_agreement")})


def call_log_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.sum("tokens").alias("tokens"), F.avg("ms").alias("avg_ms"))


def distribution(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, value, n and percent of the rows; null is 'none'. One pass over all dimensions."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dims])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("dimension").alias("d")).agg(F.sum("n").alias("all"))
    return counts.join(totals, F.col("dimension") == F.col("d")).select("dimension", "value", "n", (100.0 * F.col("n") / F.col("all")).alias("percent"))


def coverage(df: DataFrame, column: str, minimums: dict[str, int]) -> DataFrame:
    """value, required, n and met for a fixed list of values, those without rows included."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(m).alias("required")) for v, m in minimums.items()])))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "value", "left").select("value", "required", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("required")).alias("met"))


def over_represented(df: DataFrame, column: str, most: float = 0.35) -> DataFrame:
    """Values of more than ``most`` of the rows, if the column has more than two values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("values"))
    return counts.join(total).filter((F.col("values") > 2) & (F.col("n") / F.col("all") > most)).select("value", "n", (F.col("n") / F.col("all")).alias("share"))


def crosstab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row value and listed column value, 0 where there are none."""
    return df.groupBy(rows).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def evaluation_summary(df: DataFrame) -> DataFrame:
    """Per judge: evaluations and their scores."""
    return df.groupBy("judge_model").agg(F.count(F.lit(1)).alias("n"), F.avg("overall_score").alias("avg_score"), F.min("overall_score").alias("min_score"), F.max("overall_score").alias("max_score"), F.avg("jps").alias("avg_jps"))


def main_claim(df: DataFrame) -> DataFrame:
    """pdr, ccorr and their gap: how far detection runs ahead of sizing. One row."""
    pdr = df.agg(detection_aggregates()["pdr"].alias("pdr"))
    known = df.filter(F.col("outcome_degradation").isNotNull())
    both = pdr.join(spearman(known, "predicted_impact", "outcome_degradation", name="ccorr").select("ccorr"))
    return both.withColumn("gap", F.col("pdr") - F.col("ccorr"))


def claim_interval(df: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """low and high of the gap of ``main_claim`` over resamples of all rows (Poisson bootstrap).

    A replicate without real rows, with under three known outcomes or without variance has no
    gap and is left out. Under 10 rows both are null.
    """
    from .statistics import poisson_replicates, replicate_spearman

    cells = df.select((F.col("perturbation_class") != "placebo").alias("real"), F.coalesce("is_tp", F.lit(False)).alias("tp"), F.coalesce("is_fn", F.lit(False)).alias("fn"), F.col("predicted_impact").alias("x"), F.col("outcome_degradation").alias("y"))
    drawn = poisson_replicates(cells, ["real", "tp", "fn", "x", "y"], replicates, seed)
    weight = lambda c: F.sum(F.when(F.col(c), F.col("w")).otherwise(0))
    pdr = drawn.groupBy("replicate").agg(weight("real").alias("n_real"), weight("tp").alias("tp"), weight("fn").alias("fn"))
    pdr = pdr.filter("n_real > 0").select("replicate", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0)).alias("pdr"))
    gaps = pdr.join(replicate_spearman(drawn, "x", "y"), "replicate").select((F.col("pdr") - F.col("r")).alias("gap"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    edges = gaps.agg(F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))
    edge = lambda c: F.when(F.col("n") >= 10, F.col(c)).alias(c)
    return edges.join(n).select(edge("low"), edge("high"))
