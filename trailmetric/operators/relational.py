"""Joins, keyed writes and set operations: what the lookups and stores of the domain come down to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed


def left_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Left join in which columns that found no partner, or a null one, take a default."""
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``; its state is one row, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "new") -> DataFrame:
    """The union by key: on a key of both, ``new`` replaces the old row or ``old`` keeps it.  Within ``new`` keys must be unique."""
    if keep == "new":
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As a store that raises on a repeated key."""
    clash = new.join(old.select(*keys), keys, "left_semi").limit(1)
    if not clash.isEmpty():
        raise ValueError(f"duplicate key {clash.first().asDict()}")
    return old.unionByName(new, allowMissingColumns=True)


def pending(todo: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What is not done yet, for resuming a run; all of it with ``force``."""
    return todo if force else todo.join(done.select(*keys).distinct(), keys, "left_anti")


def among(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_semi")


def union_ids(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct non-null ids over several tables."""
    return reduce(DataFrame.unionByName, [f.select(column) for f in frames]).filter(F.col(column).isNotNull()).distinct()


def experiment_trajectories(perturbations: DataFrame, trajectories: DataFrame, perturbed: bool | None = None) -> DataFrame:
    """Trajectories of an experiment's perturbations: originals, perturbed ones, or both."""
    original = perturbations.select(F.col("original_trajectory_id").alias("trajectory_id"))
    changed = perturbations.select(F.col("perturbed_trajectory_id").alias("trajectory_id"))
    ids = original.union(changed) if perturbed is None else changed if perturbed else original
    return trajectories.join(ids.distinct(), "trajectory_id", "left_semi")


def trajectory_counts(perturbations: DataFrame) -> DataFrame:
    """Distinct originals, perturbed ones as they are, and distinct ids of both."""
    originals, changed = F.col("original_trajectory_id"), F.col("perturbed_trajectory_id")
    both = perturbations.select(F.explode(F.array(originals, changed)).alias("id")).agg(F.count_distinct("id").alias("all"))
    return perturbations.agg(F.count_distinct(originals).alias("original"), F.count(changed).alias("perturbed")).join(both)


def analysis_star(outputs: DataFrame, units: DataFrame, outcomes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, errors): first sample of each (unit, judge), inner to its unit, left to outcome and label; outputs without a unit are errors."""
    first = first_by(outputs, ["unit_id", "judge_model"], [F.col("sample")])
    facts = first.join(units, "unit_id").join(outcomes, "unit_id", "left").join(labels, "unit_id", "left")
    return facts, first.join(units.select("unit_id"), "unit_id", "left_anti").select("unit_id", "judge_model", F.lit("unit not found").alias("error"))


def join_judgments(units: DataFrame, judgments: DataFrame, validation: DataFrame, baselines: DataFrame) -> DataFrame:
    """Units with their last judgment by version; class validation defaults to a match and the baseline to a clean one."""
    last = last_by(judgments, ["unit_id", "version"], [F.col("at")])
    joined = units.join(last, "unit_id").join(validation, "unit_id", "left").join(baselines, "trajectory_id", "left")
    return joined.withColumns({"class_matches": F.coalesce("class_matches", F.lit(1)), "clean_baseline": F.coalesce("clean_baseline", F.lit(True))})


def evaluations_with_od(evaluations: DataFrame, perturbations: DataFrame) -> DataFrame:
    """Evaluations of perturbed trajectories with a degradation; of several perturbations the last; a missing score is 50."""
    known = last_by(perturbations.filter("od is not null").select("perturbed_trajectory_id", "od", "ord"), ["perturbed_trajectory_id"], [F.col("ord")]).drop("ord")
    joined = evaluations.join(known, evaluations["trajectory_id"] == known["perturbed_trajectory_id"])
    return joined.drop("perturbed_trajectory_id").withColumn("score", F.coalesce("score", F.lit(50.0)))


def keep_first(df: DataFrame, text: Column, order: list[Column], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): of rows whose text is equal but for white space the first stays; a duplicate names it."""
    norm = squeezed(F.coalesce(text, F.lit("")))
    keyed = df.withColumn("_key", F.md5(norm))
    first = keyed.groupBy("_key").agg(F.min_by(row_id, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("duplicate_of"))
    # Another key than the aggregation's, so the join deals its rows anew and can split those of one text.
    keyed, first = (f.withColumn("_k", F.unhex("_key")).drop("_key") for f in (keyed, first))
    joined = keyed.join(first, "_k").drop("_k")
    same = F.col(row_id).eqNullSafe(F.col("duplicate_of"))
    return joined.filter(same).drop("duplicate_of"), joined.filter(~same)


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page in a stated order, so that pages are disjoint."""
    return df.orderBy(*order).offset(skip).limit(limit)


def find(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal all given values; ``a__b`` means the nested field a.b; a None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name.replace("__", ".")) == F.lit(value))
    return df


def find_one(df: DataFrame, order: list[Column], **equal) -> DataFrame:
    """The first match in a stated order."""
    return find(df, **equal).orderBy(*order).limit(1)


def counted(df: DataFrame, **equal) -> int:
    return find(df, **equal).count()


def set_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of the distinct key sets: both, left_only, right_only."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    joined = a.join(b, keys, "full_outer")
    return joined.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """``rank`` 1..k per group; groups are cut in each task before they move."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def with_baseline_steps(baseline: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Steps of both by (trajectory_id, position), from either side."""
    b = baseline.select("trajectory_id", "position", F.col("output").alias("baseline_output"))
    p = perturbed.select("trajectory_id", "position", F.col("output").alias("perturbed_output"))
    return b.join(p, ["trajectory_id", "position"], "full_outer")
