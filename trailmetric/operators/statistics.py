"""Statistics as aggregations: average ranks, correlation, AUC, effect sizes, variance analysis, agreement, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distinct_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, average rank) of each distinct value.

    Counts per distinct value come first, so ties cost nothing, and the running count over
    them is by range partitions without groups: ranks need no single sorted task.
    """
    by = by or []
    counts = df.groupBy(*by, F.col(value)).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.withColumn("_rank", before - F.col("_n") + (F.col("_n") + 1) / 2).drop("_n")
    # A sort into ranges, a running count inside each, and the ranges' totals before it.
    placed = counts.repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_run", F.sum("_n").over(inside))
    totals = placed.groupBy("_part").agg(F.sum("_n").alias("_all"), F.min(value).alias("_low"))
    other = totals.select(F.col("_all").alias("_b_all"), F.col("_low").alias("_b_low"))
    # One row per partition on either side.
    offset = totals.join(F.broadcast(other), F.col("_b_low") < F.col("_low"), "left").groupBy("_part").agg(F.coalesce(F.sum("_b_all"), F.lit(0)).alias("_off"))
    ranked = placed.join(F.broadcast(offset), "_part")
    return ranked.select(value, (F.col("_off") + F.col("_run") - F.col("_n") + (F.col("_n") + 1) / 2).alias("_rank"))


def with_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the average rank of ``value``."""
    by = by or []
    ranks = distinct_ranks(df, value, by).withColumnRenamed("_rank", name)
    return df.join(ranks, [*by, value])


def safe_corr(x: str, y: str) -> Column:
    """corr, null where either side has no variance."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0)))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "pearson") -> DataFrame:
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "spearman", least: int = 3) -> DataFrame:
    """Correlation of average ranks; null under ``least`` rows."""
    by = by or []
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    rx = _weighted_ranks(pairs, "_x", by).withColumnRenamed("_rank", "_rx")
    ry = _weighted_ranks(pairs, "_y", by).withColumnRenamed("_rank", "_ry")
    ranked = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    w = F.col("_w")
    n, sx, sy = F.sum(w), F.sum(w * F.col("_rx")), F.sum(w * F.col("_ry"))
    cov = F.sum(w * F.col("_rx") * F.col("_ry")) - sx * sy / n
    vx = F.sum(w * F.col("_rx") * F.col("_rx")) - sx * sx / n
    vy = F.sum(w * F.col("_ry") * F.col("_ry")) - sy * sy / n
    r = F.when((vx > 0) & (vy > 0) & (n >= least), cov / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0)))
    return ranked.groupBy(*by).agg(n.alias("n"), r.alias(name))


def _weighted_ranks(pairs: DataFrame, value: str, by: list[str]) -> DataFrame:
    counts = pairs.groupBy(*by, value).agg(F.sum("_w").alias("_n"))
    if by:
        run = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.select(*by, value, (run - F.col("_n") + (F.col("_n") + 1) / 2).alias("_rank"))
    return _running(counts, value)


def _running(counts: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, average rank) from (by..., value, _n), by ranges: no task sees all values."""
    by = by or []
    placed = counts.repartitionByRange(*map(F.col, by), F.col(value)).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_run", F.sum("_n").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = placed.groupBy("_part", *by).agg(F.sum("_n").alias("_all"), F.min(value).alias("_low"))
    other = totals.select(F.col("_all").alias("_b_all"), F.col("_low").alias("_b_low"), *[F.col(c).alias(f"_b_{c}") for c in by])
    before = F.col("_b_low") < F.col("_low")
    for c in by:
        before = before & (F.col(f"_b_{c}") == F.col(c))
    offset = totals.join(F.broadcast(other), before, "left").groupBy("_part", *by).agg(F.coalesce(F.sum("_b_all"), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offset), ["_part", *by]).select(*by, value, (F.col("_off") + F.col("_run") - F.col("_n") + (F.col("_n") + 1) / 2).alias("_rank"))


def auc(df: DataFrame, positive: Column, score: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve by rank sums; null without both classes."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ranked = counts.join(_running(counts.select("_s", "_n"), "_s"), "_s")
    n1, n0 = F.sum("_p").cast("double"), (F.sum("_n") - F.sum("_p")).cast("double")
    return ranked.agg(((F.sum(F.col("_p") * F.col("_rank")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias(name))


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation, by Student's t (regularised incomplete beta)."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return beta_regularised((n - 2) / 2, 0.5, 1 - r * r)


def beta_regularised(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def f_p_value(f: float | None, between: int, within: int) -> float | None:
    """Upper tail of the F distribution."""
    if f is None or between < 1 or within < 1:
        return None
    return beta_regularised(within / 2, between / 2, within / (within + between * f))


def cohens_d(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """Effect size with pooled sample variance: 0 if that is 0, null unless each side has two rows."""
    x, y = F.when(first, F.col(value)), F.when(second, F.col(value))
    n1, n2 = F.count(x), F.count(y)
    v1, v2 = F.var_pop(x), F.var_pop(y)
    pooled = F.sqrt((n1 * v1 + n2 * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    d = F.when((n1 > 1) & (n2 > 1), F.when(pooled > 0, (F.avg(x) - F.avg(y)) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0))
    return df.agg(n1.alias("n1"), n2.alias("n2"), F.avg(x).alias("mean1"), F.avg(y).alias("mean2"), d.alias("d"))


def welch_free_t(d: float, n1: int, n2: int) -> tuple[float, float]:
    """(t, p) of the equal-variance t test from Cohen's d."""
    t = d * math.sqrt(n1 * n2 / (n1 + n2))
    df = n1 + n2 - 2
    return t, beta_regularised(df / 2, 0.5, df / (df + t * t))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way: groups, n, ss_between, ss_within, f and eta2; f is null with fewer than two groups or without variance inside."""
    per = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sums = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    sums = sums.withColumn("ss_between", F.col("s2") - F.col("s") * F.col("s") / F.nullif(F.col("n"), F.lit(0)))
    within = F.nullif(F.col("ss_within") / F.nullif(F.col("n") - F.col("groups"), F.lit(0)), F.lit(0.0))
    f = F.when(F.col("groups") >= 2, (F.col("ss_between") / F.nullif(F.col("groups") - 1, F.lit(0))) / within)
    return sums.select("groups", "n", "ss_between", "ss_within", f.alias("f"), (F.col("ss_between") / F.nullif(F.col("ss_between") + F.col("ss_within"), F.lit(0.0))).alias("eta2"))


def _nodes(low: float, high: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights of 16 to each equal part of an interval."""
    x, w = np.polynomial.legendre.leggauss(16)
    edges = np.linspace(low, high, parts + 1)
    half = np.diff(edges) / 2
    return (((edges[:-1] + edges[1:]) / 2)[:, None] + half[:, None] * x).ravel(), (half[:, None] * w).ravel()


_NORMAL = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])


def range_tail(r: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals > r): one less k * integral of phi(z) (Phi(z) - Phi(z - r))^(k-1)."""
    z, w = _nodes(-8.5, 8.5, 24)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * w
    inside = _NORMAL(z)[None, :] - _NORMAL(z[None, :] - np.asarray(r, dtype=float)[:, None])
    return 1 - k * (density * inside ** (k - 1)).sum(axis=1)


def studentised_range_tail(q: float, k: int, df: int) -> float:
    """P(Q > q) of the studentised range of k means with df degrees of freedom: the range's tail averaged over the scale sqrt(chi2 / df)."""
    if q <= 0:
        return 1.0
    # The scale's density lies around 1 with a deviation of 1 / sqrt(2 df); small df reach down to 0.
    spread = 9 / math.sqrt(2 * df)
    s, w = _nodes(max(0.0, 1 - spread), 1 + spread + 4 / df, 40)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, (w * np.exp(log_density) * range_tail(q * s, k)).sum())))


def group_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, m, v): size, mean and population variance. One row a group."""
    return df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))


def tukey_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group1, group2, difference, q, groups, df) of each pair of groups, smaller name first: its studentised difference by the variance inside all groups.

    q is 0 without variance; no rows with fewer than two groups, or without a degree of freedom. One row a pair is the result's own size.
    """
    per = group_statistics(df, value, group)
    whole = per.agg(F.count(F.lit(1)).alias("groups"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum(F.col("n") * F.col("v")).alias("ss")).filter("df >= 1")
    side = lambda i: per.select(F.col("group").alias(f"group{i}"), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}"))
    pairs = side(1).join(side(2), F.col("group1") < F.col("group2")).crossJoin(whole)
    se = F.sqrt(F.col("ss") / F.col("df") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    q = F.when(se > 0, F.abs(F.col("m1") - F.col("m2")) / F.nullif(se, F.lit(0.0))).otherwise(0.0)
    return pairs.select("group1", "group2", (F.col("m2") - F.col("m1")).alias("difference"), q.alias("q"), "groups", "df")


def tukey_hsd(df: DataFrame, value: str, group: str) -> list[dict]:
    """Pairs of groups with their difference, q and p, by exact quadrature of the studentised range."""
    rows = tukey_pairs(df, value, group).orderBy("group1", "group2").collect()  # one row a pair of groups
    return [{"group1": r.group1, "group2": r.group2, "difference": r.difference, "q": r.q, "p": studentised_range_tail(r.q, r.groups, r.df)} for r in rows]


#: Error types by kind, and the sides of the four contrasts.
STRUCTURAL_TYPES, SURFACE_TYPES = ("planning", "tool_selection"), ("parameter", "data_reference")


def contrasts(kind: str = "perturbation_type", position: str = "position") -> dict[str, tuple[Column, Column]]:
    at = lambda p: F.col(position) == p
    structural, surface = F.col(kind).isin(*STRUCTURAL_TYPES), F.col(kind).isin(*SURFACE_TYPES)
    return {
        "early_vs_late": (at("early"), at("late")),
        "planning_vs_parameter": (F.col(kind) == "planning", F.col(kind) == "parameter"),
        "structural_vs_surface": (structural, surface),
        "early_structural_vs_late_surface": (at("early") & structural, at("late") & surface),
    }


def effect_contrasts(df: DataFrame, value: str = "ccg", sides: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """contrast, n1, n2, mean1, mean2, d (pooled, 0 without variance) of each pair of sides with two rows or more each: one pass for all."""
    sides = sides or contrasts()
    aggs = []
    for name, pair in sides.items():
        for i, side in enumerate(pair):
            v = F.when(side, F.col(value))
            aggs += [F.count(v).alias(f"{name}_n{i}"), F.avg(v).alias(f"{name}_m{i}"), F.var_pop(v).alias(f"{name}_v{i}")]
    one = df.agg(*aggs)

    def row(name: str) -> Column:
        n1, n2, m1, m2, v1, v2 = (F.col(f"{name}_{k}{i}") for k in "nmv" for i in (0, 1))
        pooled = F.sqrt((n1 * v1 + n2 * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
        d = F.when(pooled > 0, (m1 - m2) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)
        return F.struct(F.lit(name).alias("contrast"), n1.alias("n1"), n2.alias("n2"), m1.alias("mean1"), m2.alias("mean2"), d.alias("d"))

    return one.select(F.inline(F.array(*map(row, sides)))).filter("n1 > 1 and n2 > 1")


def assess_hypothesis(df: DataFrame, value: str = "ccg") -> DataFrame:
    """One row: means of early structural and late surface errors, effect size, t and p of their difference, the five criteria and the support they give."""
    both = contrasts()["early_structural_vs_late_surface"]
    found = df.agg(*[f(F.when(side, F.col(value))).alias(f"{n}{i}") for i, side in enumerate(both) for f, n in ((F.count, "n"), (F.avg, "m"))]).first()
    pairs = effect_contrasts(df, value, {"key": both}).collect()  # one row at most
    d = pairs[0].d if pairs else None
    t, p = welch_free_t(d, found.n0, found.n1) if d is not None else (None, None)
    early, late = found.m0, found.m1
    criteria = {
        "early_under_penalized": early is not None and early < 0,
        "late_over_penalized": late is not None and late > 0,
        "direction_correct": early is not None and late is not None and early < late,
        "statistically_significant": p is not None and p < 0.05,
        "meaningful_effect_size": d is not None and abs(d) > 0.5,
    }
    names = ", ".join(f"{c} boolean" for c in criteria)
    schema = f"early_structural_mean double, late_surface_mean double, d double, t double, p_value double, {names}, criteria_met int, support string"
    return df.sparkSession.createDataFrame([(early, late, d, t, p, *criteria.values(), sum(criteria.values()), hypothesis_strength(criteria))], schema)


def hypothesis_strength(criteria: dict[str, bool]) -> str:
    """Strength of support by how many of five criteria hold."""
    met = sum(map(bool, criteria.values()))
    return "strong" if met >= 4 else "moderate" if met == 3 else "weak" if met == 2 else "not supported"


def last_values(df: DataFrame, unit: str, annotator: str, value: str, order: str) -> DataFrame:
    """(u, a, v): the last non-null value, as text, that an annotator gave a unit."""
    known = df.filter(F.col(unit).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.col(unit).alias("u"), F.col(annotator).alias("a")).agg(F.max_by(F.col(value).cast("string"), order).alias("v"))


def pooled_alphas(df: DataFrame, unit: str, levels: dict[str, str], annotator: str = "annotator_id", order: str = "seq") -> DataFrame:
    """Pooled agreement alpha of each dimension (column): n_units, n_annotators, n_observations, observed, expected, alpha, band; one pass for all.

    Over units of two annotators or more: disagreement summed over the pairs inside units, and over all pairs of
    values, both shares of n(n-1)/2 for the n values. Values are coded in the order of their text; the difference
    of two codes is 0 or 1 (nominal) or their squared distance (ordinal and interval, as codes are dense). Closed forms
    over counts replace the pairs. One value alone gives 1; no expected disagreement 1 or null; no such unit null.
    """
    if unknown := set(levels.values()) - {"nominal", "ordinal", "interval"}:
        raise ValueError(f"unknown level {sorted(unknown)}")
    said = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("v")) for d in levels])
    each = df.filter(F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col(annotator).alias("a"), F.col(order).alias("o"), F.explode(said).alias("s")).select("u", "a", "o", "s.*")
    rows = each.filter("v is not null").groupBy("dimension", "u", "a").agg(F.max_by("v", "o").alias("v"))
    per = rows.groupBy("dimension", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    several = per.groupBy("dimension", "u").agg(F.sum("n").alias("m")).filter("m > 1").select("dimension", "u")
    per = per.join(several, ["dimension", "u"])
    totals = per.groupBy("dimension", "v").agg(F.sum("n").alias("n"))
    codes = _running(totals.select("dimension", "v", F.lit(1).alias("_n")), "v", ["dimension"]).select("dimension", "v", (F.col("_rank") - 1).alias("code"))
    squared = F.col("dimension").isin(*[d for d, level in levels.items() if level != "nominal"])

    def bad(frame: DataFrame, *by: str) -> DataFrame:
        """Summed disagreement of all pairs: n * sum(c^2) - sum(c)^2, or those of unequal values."""
        n, c = F.col("n"), F.col("code")
        unequal = F.sum(n) * (F.sum(n) - 1) / 2 - F.sum(n * (n - 1) / 2)
        square = F.sum(n) * F.sum(n * c * c) - F.pow(F.sum(n * c), 2)
        out = frame.join(codes, ["dimension", "v"]).groupBy(*by).agg(unequal.alias("unequal"), square.alias("square"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("labels"))
        return out.withColumn("bad", F.when(squared, F.col("square")).otherwise(F.col("unequal")))

    inside = bad(per, "dimension", "u").groupBy("dimension").agg(F.count(F.lit(1)).alias("n_units"), F.sum("bad").alias("inside"))
    every = bad(totals, "dimension").select("dimension", F.col("bad").alias("every"), F.col("m").alias("n"), "labels")
    sizes = rows.groupBy("dimension").agg(F.count_distinct("a").alias("n_annotators"), F.count(F.lit(1)).alias("n_observations"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, levels))).alias("dimension"))
    both = names.join(sizes, "dimension", "left").join(inside, "dimension", "left").join(every, "dimension", "left").na.fill(0, ["n_units", "n_annotators", "n_observations"])
    pairs = F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
    both = both.withColumns({"observed": F.col("inside") / pairs, "expected": F.col("every") / pairs})
    alpha = (
        F.when((F.col("n_units") == 0) | (F.col("n_annotators") < 2), F.lit(None).cast("double"))
        .when(F.col("labels") < 2, 1.0)
        .when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0))
        .otherwise(1 - F.col("observed") / F.nullif("expected", F.lit(0.0)))
    )
    return both.withColumn("alpha", alpha).select("dimension", "n_units", "n_annotators", "n_observations", "observed", "expected", "alpha", alpha_band(F.col("alpha")).alias("band"))


def pooled_alpha(df: DataFrame, unit: str, value: str, level: str = "nominal", annotator: str = "annotator_id", order: str = "seq") -> DataFrame:
    """``pooled_alphas`` of one dimension."""
    return pooled_alphas(df, unit, {value: level}, annotator, order).drop("dimension")


def alpha_band(alpha: Column) -> Column:
    return F.when(alpha >= 0.8, "high").when(alpha >= 0.6, "acceptable").when(alpha >= 0.4, "moderate").when(alpha.isNotNull(), "low").otherwise("insufficient_data")


#: Annotators in a block, 2 ** BITS at most; slices that units are dealt to by their hash; records with votes that a Python worker gets at once; votes that it counts at once.
BITS, SLICES, RECORDS, LOT = 12, 1024, 256, 1 << 21


def agreement_blocks(df: DataFrame, unit: str, annotator: str, value: str, order: str) -> DataFrame:
    """(i, j, block, slice, votes, names): of every pair of blocks of annotators, in a partition, the names of both (slice -1) and then their votes by slices of units.

    Annotators are numbered in their order, up to 2 ** BITS to a block, but fewer where that made less than 8 blocks. A vote is a long: the unit's number in its slice (25 bits), the
    value's number in its unit (26) and the annotator's in the block. Votes are sent once for each block, so that what
    is shuffled grows with votes times blocks, and not with the pairs of annotators that meet in a unit.
    """
    spark = df.sparkSession
    known = df.filter(F.col(unit).isNotNull() & F.col(value).isNotNull() & F.col(annotator).isNotNull())
    numbers = _running(known.select(F.col(annotator).alias("a")).distinct().withColumn("_n", F.lit(1)), "a")
    number = F.col("_rank").cast("long") - 1
    size = F.least(F.lit(1 << BITS), F.greatest(F.lit(64), F.ceil(F.col("_all") / 8)))
    people = numbers.crossJoin(F.broadcast(numbers.agg(F.count(F.lit(1)).alias("_all")))).select("a", F.floor(number / size).cast("int").alias("block"), (number % size).alias("at"))  # by one row
    rows = last_values(known, unit, annotator, value, order).withColumn("slice", F.pmod(F.xxhash64("u"), F.lit(SLICES)).cast("int"))
    coded = rows.select("slice", "a", F.dense_rank().over(Window.partitionBy("slice", "u").orderBy("v")).alias("_v"), F.dense_rank().over(Window.partitionBy("slice").orderBy("u")).alias("_u"))
    vote = F.shiftleft(F.col("_u").cast("long"), BITS + 26) + F.shiftleft(F.col("_v").cast("long"), BITS) + F.col("at")
    votes = coded.join(people, "a").select("block", "slice", vote.alias("vote")).groupBy("block", "slice").agg(F.sort_array(F.collect_list("vote")).alias("votes"))
    names = people.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("names"))
    both = votes.select("block", "slice", "votes", F.lit(None).cast(names.schema["names"].dataType).alias("names"))
    both = both.unionByName(names.select("block", F.lit(-1).alias("slice"), F.lit(None).cast("array<bigint>").alias("votes"), "names"))
    last = people.agg(F.max("block").alias("_last"))  # one row
    both = both.crossJoin(F.broadcast(last)).withColumn("other", F.explode(F.sequence(F.lit(0), "_last")))
    both = both.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "slice", "votes", "names")
    # The number is given, as a pair of blocks is much work in few bytes, and partitions are else joined by their bytes.
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i", "j").sortWithinPartitions("i", "j", "slice")


def met_in_blocks(blocks: DataFrame, found, schema: T.StructType) -> DataFrame:
    """``found(differ, agreed, left, right, same)`` gives record batches for each pair of blocks: names of both and, by their places, units with unequal and with equal values of two.

    A worker holds these counts and a lot of votes, however many units there are; a few annotators at a time are counted, in a cache.
    """
    limit = int(blocks.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < limit <= RECORDS:
        blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))
    bits, lot, most, few = BITS, LOT, 1 << 18, 16

    def add(differ: np.ndarray, agreed: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Counts the pairs of some slices, in each of which votes are in order of their units."""
        width, low_bits = differ.shape[1], (1 << bits) - 1
        left, right = (np.concatenate(x) for x in zip(*pieces, strict=True))
        lu, ru = (np.concatenate([(x[side] >> (bits + 26)) + (k << 26) for k, x in enumerate(pieces)]) for side in (0, 1))
        units, start, n = np.unique(ru, return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(units, lu), len(units) - 1)
        both = np.flatnonzero(units[at] == lu)
        order = both[np.argsort(left[both] & low_bits, kind="stable")]
        left, start, n = left[order], start[at[order]], n[at[order]]
        who, said = left & low_bits, left >> bits & ((1 << 26) - 1)
        r_who, r_said = right & low_bits, right >> bits & ((1 << 26) - 1)
        ends = np.cumsum(n)
        for low in range(0, len(differ), few):
            done, stop = np.searchsorted(who, (low, low + few)).tolist()
            rows, size = slice(low, low + few), min(few, len(differ) - low) * width
            while done < stop:
                upto = min(stop, max(done + 1, int(np.searchsorted(ends, ends[done] - n[done] + most, "right"))))
                t = n[done:upto]
                to = np.repeat(start[done:upto] - np.cumsum(t) + t, t) + np.arange(t.sum())
                cell = np.repeat((who[done:upto] - low) * width, t) + r_who[to]
                cell += (np.repeat(said[done:upto], t) == r_said[to]) * size
                counts = np.bincount(cell, minlength=2 * size).reshape(2, -1, width)
                differ[rows] += counts[0]
                agreed[rows] += counts[1]
                done = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = at = planes = None
        names, votes, pieces = {}, {}, []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Takes up the slice that was read, and the pair of blocks if it was the last of it."""
            nonlocal planes
            i, j = pair
            if len(votes) == len({i, j}):
                pieces.append((votes[i], votes[j]))
            votes.clear()
            if last or sum(len(x) + len(y) for x, y in pieces) >= lot:
                if planes is None:
                    planes = np.zeros((2, len(names[i]), len(names[j])), dtype=np.int32)
                if pieces:
                    add(*planes, pieces)
                    pieces.clear()
            if last:
                yield from found(*planes, names[i], names[j], i == j)
                planes = None
                names.clear()

        for batch in batches:
            lists = batch.column("votes")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r, (i, j, block, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "block", "slice")), strict=True)):
                if pair is not None and (pair, at) != ((i, j), piece):
                    yield from settle(pair != (i, j))
                pair, at = (i, j), piece
                if piece < 0:
                    names[block] = batch.column("names")[r].values
                else:
                    votes[block] = values[offsets[r] : offsets[r + 1]]
        if pair is not None:
            yield from settle(True)

    return blocks.mapInArrow(run, schema)


def pairwise_agreement(df: DataFrame, unit: str, annotator: str, value: str, order: str = "seq") -> DataFrame:
    """a1, a2, shared, agreed, rate for every pair of annotators with a value, those without a shared unit included.

    An annotator's last known value of a unit counts. The result has a row for each pair of annotators, by its contract; pairs are
    counted by blocks of annotators and neither joined nor shuffled.
    """
    kind = df.schema[annotator].dataType
    schema = T.StructType([T.StructField("a1", kind), T.StructField("a2", kind), *[T.StructField(c, T.LongType()) for c in ("shared", "agreed")], T.StructField("rate", T.DoubleType())])

    def found(differ: np.ndarray, agreed: np.ndarray, left: pa.Array, right: pa.Array, same: bool) -> Iterator[pa.RecordBatch]:
        width = differ.shape[1]
        for low in range(0, len(left), step := max(1, 65536 // width)):
            n = agreed[low : low + step]
            m = n + differ[low : low + step]
            x, y = np.repeat(np.arange(low, low + len(m)), width), np.tile(np.arange(width), len(m))
            m, n = m.ravel().astype(np.int64), n.ravel().astype(np.int64)
            if same:
                keep = x < y
                m, n, x, y = m[keep], n[keep], x[keep], y[keep]
            rate = pa.array(n / np.maximum(m, 1), mask=m == 0)
            yield pa.RecordBatch.from_arrays([left.take(pa.array(x)), right.take(pa.array(y)), pa.array(m), pa.array(n), rate], names=["a1", "a2", "shared", "agreed", "rate"])

    return met_in_blocks(agreement_blocks(df, unit, annotator, value, order), found, schema)


def overall_agreement(df: DataFrame, unit: str, annotator: str, value: str, order: str = "seq") -> DataFrame:
    """shared, agreed and their ratio over all pairs of annotators: null without a shared unit, and all null without a pair of annotators.

    A unit of n annotators has n(n-1)/2 pairs, so counts by unit and value replace the pairs.
    """
    rows = last_values(df, unit, annotator, value, order).filter("a is not null")
    per = rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("u").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreed"))
    whole = per.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("shared"), F.sum("agreed").alias("agreed"))
    several = rows.agg(F.min("a") < F.max("a")).toDF("several")  # one row on either side
    half = lambda c: F.when(F.col("several"), F.shiftright(F.col(c), 1))
    both = whole.crossJoin(several).select(half("shared").alias("shared"), half("agreed").alias("agreed"))
    return both.withColumn("rate", F.col("agreed") / F.nullif("shared", F.lit(0)))


def annotator_agreement(df: DataFrame, unit: str, annotator: str, value: str, order: str = "seq") -> DataFrame:
    """annotator, n_annotations (units with a value) and the mean of the rates with the others that share a unit.

    Rates are added up where pairs are counted, so none is shuffled.
    """
    own = last_values(df, unit, annotator, value, order).groupBy("a").agg(F.count(F.lit(1)).alias("n_annotations"))
    schema = T.StructType([T.StructField("b", df.schema[annotator].dataType), T.StructField("rates", T.DoubleType()), T.StructField("others", T.LongType())])

    def found(differ: np.ndarray, agreed: np.ndarray, left: pa.Array, right: pa.Array, same: bool) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n) for n in differ.shape]
        others = [np.zeros(n, dtype=np.int64) for n in differ.shape]
        for low in range(0, len(left), 16):
            rows = slice(low, low + 16)
            n = agreed[rows]
            m = n + differ[rows]
            if same:
                m, n = np.triu(m, low + 1), np.triu(n, low + 1)
            met, rate = m > 0, n / np.maximum(m, 1)
            for to, axis, part in ((0, 1, rows), (1, 0, slice(None))):
                sums[to][part] += rate.sum(axis=axis)
                others[to][part] += np.count_nonzero(met, axis=axis)
        for who, rates, n in zip((left, right), sums, others, strict=True):
            yield pa.RecordBatch.from_arrays([who, pa.array(rates), pa.array(n)], names=["b", "rates", "others"])

    sides = met_in_blocks(agreement_blocks(df, unit, annotator, value, order), found, schema)
    means = sides.groupBy("b").agg((F.sum("rates") / F.nullif(F.sum("others"), F.lit(0))).alias("mean_agreement"))
    return own.join(means, F.col("a") == F.col("b"), "left").select(F.col("a").alias("annotator"), "n_annotations", "mean_agreement")


def bootstrap_ci(df: DataFrame, statistic: str, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval (linear interpolation) of the mean by Poisson bootstrap.

    Equal values are drawn together, so the work grows with the distinct values, not with the rows.
    """
    drawn = poisson_replicates(df.select(F.col(value).cast("double").alias("v")).filter("v is not null"), ["v"], replicates, seed)
    per = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias(statistic))
    low, high = (1 - level) / 2, (1 + level) / 2
    return per.agg(F.avg(statistic).alias("mean"), F.percentile(statistic, F.lit(low)).alias("low"), F.percentile(statistic, F.lit(high)).alias("high"), F.count(statistic).alias("replicates"))


def correlation_interval(df: DataFrame, x: str, y: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(low, high) of the rank correlation by Poisson bootstrap, at the sorted replicates' places; nulls without a replicate that has one."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return index_interval(replicate_spearman(poisson_replicates(known, ["x", "y"], replicates, seed), "x", "y"), "r", alpha)


#: Draws of a cell by exact inversion reach this size; what exceeds it is drawn as a rounded normal value with Poisson skewness.
EXACT = 32


def poisson_thresholds(mean: int) -> list[int]:
    """P(X <= j) in units of 2^-32, for j = 0, 1, ... while below one: a digit of 32 bits draws the number of thresholds that it reaches."""
    out, j, below = [], 0, 0.0
    while True:
        below += math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1))
        j += 1
        if below >= 1 - 2.0**-33:
            return out
        out.append(math.floor(below * 2.0**32))


def poisson_replicates(df: DataFrame, columns: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, *columns, w): the weight of every distinct row in each Poisson resample of ``df``; zero weights are left out.

    n equal rows with Poisson(1) weights each weigh Poisson(n) together, so one draw stands for all of them. The draw comes from
    the SHA-256 of seed, replicate and values, eight digits of 32 bits: one for each of the powers of two that add up to
    n mod 32, by inversion, and two for a normal value where n is 32 or more. It depends on neither partitions nor order, and any
    engine with SHA-256 can repeat it. Numbers enter by their floor and the fraction in units of 2^-52, all else as text.
    """
    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))

    def key(name: str) -> Column:
        c, kind = F.col(name), cells.schema[name].dataType
        if isinstance(kind, T.FractionalType):
            whole = F.floor(c.cast("double"))
            text = F.concat_ws(":", whole, F.floor((c.cast("double") - whole) * 2.0**52))
        else:
            text = (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("string")
        return F.when(c.isNull(), "null").otherwise(text)

    keyed = cells.withColumn("_key", F.concat_ws("|", *map(key, columns)))
    drawn = keyed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("_sha", F.sha2(F.concat_ws("|", F.lit(str(seed)), "replicate", "_key"), 256))
    digit = lambda i: F.conv(F.substring("_sha", 8 * i + 1, 8), 16, 10).cast("long")

    def reached(bit: int) -> Column:
        # One element, so that the digit is read once and not for each threshold.
        marks = F.array(*map(F.lit, poisson_thresholds(1 << bit)))
        return F.transform(F.array(digit(bit)), lambda d: F.size(F.filter(marks, lambda t: t <= d)))[0]

    weight = F.lit(0)
    for bit in range(EXACT.bit_length() - 1):
        weight = weight + F.when(F.col("_n").bitwiseAND(1 << bit) > 0, reached(bit)).otherwise(0)
    large = F.col("_n") - F.col("_n").bitwiseAND(EXACT - 1)
    unit = lambda i: (digit(i) + 0.5) / 2.0**32
    z = F.sqrt(-2 * F.log(unit(5))) * F.cos(2 * math.pi * unit(6))
    normal = F.greatest(F.lit(0), F.floor(large + F.sqrt(large.cast("double")) * z + (z * z - 1) / 6 + 0.5))
    drawn = drawn.withColumn("w", (weight + F.when(large > 0, normal).otherwise(0)).cast("long"))
    return drawn.filter("w > 0").select("replicate", *columns, "w")


def replicate_spearman(drawn: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """(replicate, r): correlation of average ranks in each replicate by weights ``w``; only replicates that have one.

    Ranks run over ranges of (replicate, value), so neither a replicate nor a frequent value is one task.
    """
    pairs = drawn.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("replicate", F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.sum("w").alias("_w"))
    rank = lambda v, name: _running(pairs.groupBy("replicate", v).agg(F.sum("_w").alias("_n")), v, ["replicate"]).withColumnRenamed("_rank", name)
    ranked = pairs.join(rank("_x", "_rx"), ["replicate", "_x"]).join(rank("_y", "_ry"), ["replicate", "_y"])
    w = F.col("_w")
    n, sx, sy = F.sum(w), F.sum(w * F.col("_rx")), F.sum(w * F.col("_ry"))
    cov = F.sum(w * F.col("_rx") * F.col("_ry")) - sx * sy / n
    vx = F.sum(w * F.col("_rx") * F.col("_rx")) - sx * sx / n
    vy = F.sum(w * F.col("_ry") * F.col("_ry")) - sy * sy / n
    r = F.when((vx > 0) & (vy > 0) & (n >= least), cov / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0)))
    return ranked.groupBy("replicate").agg(r.alias("r")).filter("r is not null")


def index_interval(values: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """(low, high): the sorted values at int(alpha / 2 * n) and int((1 - alpha / 2) * n) - 1, of a table of replicates."""
    held = values.agg(F.array_sort(F.collect_list(value)).alias("v"))  # as many values as replicates
    n = F.size("v")
    return held.select(F.get("v", F.floor(n * (alpha / 2)).cast("int")).alias("low"), F.get("v", (F.floor(n * (1 - alpha / 2)) - 1).cast("int")).alias("high"))
