"""Deterministic sampling: shuffles, quotas, caps, weights and assignments by hash order.

The order of a key is the MD5 of seed and key, so a sample depends on neither partitions
nor engine.  Quotas rank rows inside their stratum; positions in a whole table are by
ranges of the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def uniform(seed: int, key: str) -> Column:
    """(0, 1) from the first 13 hex digits of the order key."""
    return (F.conv(F.substring(order_key(seed, key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, key), key).limit(n)


def per_stratum(df: DataFrame, strata: list[str], key: str, quota: Column, seed: int = 42, most: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order; where no quota exceeds ``most``, tasks cut strata to that before they send them."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(order_key(seed, key), key)))
    if most is not None:
        ranked = ranked.filter(F.col("_rank") <= max(most, 0))
    return ranked.filter(F.col("_rank") <= quota).drop("_rank")


def quota_column(column: str, quotas: dict[str, int], otherwise: int = 0) -> Column:
    out = F.when(F.lit(False), 0)
    for value, n in quotas.items():
        out = out.when(F.col(column) == value, n)
    return out.otherwise(otherwise)


def split_quota(total: int, ratios: dict[str, float], remainder_to: str) -> dict[str, int]:
    """int(total * ratio) each, what is left over to one."""
    quotas = {k: int(total * r) for k, r in ratios.items()}
    quotas[remainder_to] += total - sum(quotas.values())
    return quotas


def with_fill(df: DataFrame, column: str, key: str, quotas: dict[str, int], fill_order: list[str], seed: int = 42) -> DataFrame:
    """Quotas per value, then a shortfall filled from what is left of the values in ``fill_order``."""
    total = sum(quotas.values())
    rank = F.row_number().over(Window.partitionBy(column).orderBy(order_key(seed, key), key))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, fill_order)), F.col(column)), F.lit(0)), F.lit(len(fill_order) + 1))
    # At most ``total`` rows of a value can be taken, so the frame ranked as a whole is small.
    ranked = df.withColumn("_rank", rank).filter(F.col("_rank") <= total).withColumn("_quota", quota_column(column, quotas))
    order = [(F.col("_rank") > F.col("_quota")).cast("int"), F.when(F.col("_rank") > F.col("_quota"), place).otherwise(0), order_key(seed, key), F.col(key)]
    return ranked.orderBy(*order).limit(total).drop("_rank", "_quota")


def class_sample(df: DataFrame, total: int, ratios: dict[str, float], key: str = "perturbation_id", column: str = "perturbation_class", remainder_to: str = "fine_grained", seed: int = 42) -> DataFrame:
    """Primary rows by class ratios, a shortfall filled in the ratios' order."""
    return with_fill(df.filter("is_primary_for_experiment"), column, key, split_quota(total, ratios, remainder_to), list(ratios), seed)


def complexity_rebalance(df: DataFrame, target: int, key: str = "trajectory_id", seed: int = 42) -> DataFrame:
    quotas = split_quota(target, {"simple": 0.2, "medium": 0.5, "complex": 0.3}, "medium")
    return with_fill(df, "complexity", key, quotas, ["medium", "complex", "simple"], seed)


def domain_caps(df: DataFrame, target: int, caps: dict[str, float], key: str = "trajectory_id", seed: int = 42) -> DataFrame:
    """At most int(target * cap) rows of a capped domain, all of the others, shuffled to ``target``."""
    quota = quota_column("domain", {d: int(target * c) for d, c in caps.items()}, otherwise=target)
    return shuffled_head(per_stratum(df, ["domain"], key, quota, seed, most=target), key, target, seed)


def fair_shares(df: DataFrame, benchmark: str, domain: str, targets: dict[str, int], key: str = "trajectory_id", oversample: float = 1.5, seed: int = 42) -> DataFrame:
    """Per benchmark a target, oversampled, with no domain over twice its fair share."""
    domains = df.groupBy(benchmark).agg(F.count_distinct(domain).alias("_domains"))
    want = quota_column(benchmark, {b: int(n * oversample) for b, n in targets.items()})
    cap = F.ceil(2 * want / F.greatest(F.col("_domains"), F.lit(1)))
    most = max([int(n * oversample) for n in targets.values()], default=0)
    inside = per_stratum(df.join(domains, benchmark), [benchmark, domain], key, cap, seed, most=2 * most).drop("_domains")
    return per_stratum(inside, [benchmark], key, want, seed, most=most)


def downsample(df: DataFrame, column: str, target: int, weights: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """int(target * weight) rows per class at most, none of other classes, none added."""
    quotas = {c: int(target * w) for c, w in weights.items()}
    return per_stratum(df, [column], key, quota_column(column, quotas), seed, most=max(quotas.values(), default=0))


def weighted_without_replacement(df: DataFrame, weight: Column, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, each drawn in proportion to its weight: the smallest -ln(u) / w."""
    rows = df.withColumn("_w", weight).filter(F.col("_w") > 0)
    return rows.orderBy(-F.log(uniform(seed, key)) / F.col("_w"), key).limit(k).drop("_w")


def with_minimums(df: DataFrame, column: str, minimums: dict[str, int], total: int, key: str, seed: int = 42) -> DataFrame:
    """The minimum of each value first, then up to ``total`` weighted by 1 / (1 + share of what is chosen already)."""
    first = per_stratum(df, [column], key, quota_column(column, minimums), seed, most=max(minimums.values(), default=0))
    chosen = first.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    rest = df.join(first.select(key), key, "left_anti").join(chosen, column, "left")
    n = sum(minimums.values())
    more = weighted_without_replacement(rest, 1 / (1 + F.coalesce("_c", F.lit(0)) / max(n, 1)), key, max(total - n, 0), seed)
    return first.unionByName(more.select(*df.columns)).limit(total)


def coverage_weights(column: str, counts: DataFrame, selected: int) -> Column:
    """1 / (1 + count / selected), or 2 for a value not chosen yet; to be used after a left join to ``counts`` (column, n)."""
    return F.when(F.col("n").isNull(), 2.0).otherwise(1 / (1 + F.col("n") / max(selected, 1)))


def cascade(df: DataFrame, steps: list[tuple[str, Column, int]], total: int, key: str, seed: int = 42) -> DataFrame:
    """Rows by a priority cascade: each step takes its quota of the rows that no step before took; then any up to ``total``.

    A row beyond one step's quota can still be taken by a later one.  Each step is a distributed top-k; the next ones
    leave out what it took, which the planner broadcasts if its size allows.
    """
    order = [order_key(seed, key), F.col(key)]
    left, parts = df, []
    for name, condition, quota in [*steps, ("fill", F.lit(True), total)]:  # the last limit settles how many fill up
        picked = left.filter(condition).orderBy(*order).limit(quota).withColumn("stage", F.lit(name))
        parts.append(picked.withColumn("_at", F.lit(int(name == "fill"))))
        left = left.join(picked.select(key), key, "left_anti")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("_at", *order).limit(total).drop("_at")


def numbered(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``position`` from 0 in hash order: ranks inside the ranges of the hash's first digits, after the counts of the ranges before.

    The ranges are fixed (4096), so no task ranks all rows and only their counts meet in one place.
    """
    # Ranges in the order of the hash; a null key has the hash of the seed alone, as any other.
    placed = df.withColumn("_range", F.substring(order_key(seed, key), 1, 3))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order_key(seed, key), key)) - 1
    ranked = placed.withColumn("_at", inside).join(F.broadcast(offset), F.col("_range") == F.col("_of"))
    return ranked.select(*df.columns, (F.col("_before") + F.col("_at")).cast("int").alias("position"))


def round_robin(df: DataFrame, key: str, annotators: list[str], seed: int = 42) -> DataFrame:
    names = F.array(*map(F.lit, annotators))
    return numbered(df, key, seed).withColumn("annotator", F.get(names, (F.col("position") % len(annotators)).cast("int")))


def batched(df: DataFrame, by: list[str], order: list[Column], size: int = 25) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("int"))


def overlap(df: DataFrame, key: str, annotators: list[str], to_all: int = 50, paired: int = 100, seed: int = 42) -> DataFrame:
    """One row per (unit, annotator): the first units go to all, the next to a pair in turn, the rest to one in turn."""
    n = len(annotators)
    names = F.array(*map(F.lit, annotators))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, 0)]
    two = F.array(*[F.array_distinct(F.array(F.lit(annotators[i]), F.lit(annotators[j]))) for i, j in pairs])
    at = F.col("position")
    who = (
        F.when(at < to_all, names)
        .when(at < to_all + paired, F.get(two, ((at - to_all) % len(pairs)).cast("int")))
        .otherwise(F.array(F.get(names, ((at - to_all - paired) % n).cast("int"))))
    )
    return numbered(df, key, seed).withColumn("annotator", F.explode(who))


def dealt(pool: DataFrame, takers: DataFrame, pool_key: str, taker_key: str, each: int, seed: int = 42) -> DataFrame:
    """A shuffled pool dealt ``each`` to a taker."""
    cards = numbered(pool, pool_key, seed).withColumn("_turn", F.floor(F.col("position") / each).cast("int")).drop("position")
    hands = numbered(takers, taker_key, seed).withColumnRenamed("position", "_turn")
    return cards.join(hands, "_turn").drop("_turn")


def class_needs(df: DataFrame, column: str, targets: dict[str, int]) -> DataFrame:
    """class, target, n and need of every target class, and which one is needed most (the first of equals)."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(t).alias("target")) for c, t in targets.items()])).alias("ord", "x")).select("ord", "x.*")
    have = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rows = wanted.join(have, "class", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("need", F.greatest(F.col("target") - F.col("n"), F.lit(0)))
    most = rows.agg(F.max_by("class", F.struct("need", (-F.col("ord")).alias("o"))).alias("suggested"))
    return rows.join(most).select("class", "target", "n", "need", (F.col("class") == F.col("suggested")).alias("suggested"))


def greedy_select(candidates: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Per trajectory, candidates by score: a class's quota, and no step twice unless it is the class's last place.

    Sequential by nature: a fold over each trajectory's candidates, as many as it has slots, in the JVM.
    """
    row = F.struct((-F.col("score")).alias("below"), F.col("candidate_id").alias("by"), F.struct(*candidates.columns).alias("row"))
    kind = candidates.select(F.struct(*candidates.columns).alias("row")).schema["row"].dataType.simpleString()
    step_kind = candidates.schema["step_index"].dataType.simpleString()
    names = list(quotas)
    start = F.struct(
        F.expr(f"cast(array() as array<{step_kind}>)").alias("steps"),
        F.expr(f"cast(array() as array<{kind}>)").alias("out"),
        *[F.lit(quotas[c]).alias(f"q{i}") for i, c in enumerate(names)],
    )

    def take(acc: Column, x: Column) -> Column:
        c = x["row"]["perturbation_class"]
        room = F.coalesce(*[F.when(c == name, acc[f"q{i}"]) for i, name in enumerate(names)], F.lit(0))
        ok = (room > 0) & (~F.array_contains(acc["steps"], x["row"]["step_index"]) | (room == 1))
        return F.struct(
            F.when(ok, F.array_append(acc["steps"], x["row"]["step_index"])).otherwise(acc["steps"]).alias("steps"),
            F.when(ok, F.array_append(acc["out"], x["row"])).otherwise(acc["out"]).alias("out"),
            *[F.when(ok & (c == name), acc[f"q{i}"] - 1).otherwise(acc[f"q{i}"]).alias(f"q{i}") for i, name in enumerate(names)],
        )

    known = candidates.filter(F.col("step_index").isNotNull() & F.col("perturbation_class").isNotNull())
    per = known.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(row)).alias("_c"))
    return per.select(F.inline(F.aggregate("_c", start, take, lambda acc: acc["out"])))


def in_batches(df: DataFrame, call, schema, size: int = 50) -> DataFrame:
    """Rows through an outside ``call(frame) -> frame`` in batches; a batch that fails gives its rows with status 'failed'."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                try:
                    yield call(part).assign(status="success")
                except Exception as error:  # one bad batch must not lose the others
                    yield part.assign(status="failed", error=str(error)).reindex(columns=[f.name for f in schema])

    return df.mapInPandas(run, schema)
