"""Generation of perturbations: candidates of all families, a selection by class, and a record for each that applies.

Input: trajectories (trajectory_id, benchmark, steps: array of ``structural.STEP``) and their slots (trajectory_id, step_index,
slot, value_type, value, allowed). Choices come from hashes; a class is looked for in the order fine, placebo, coarse.
A trajectory's candidates come together in one row, as its steps do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions.text import position_by_thirds
from . import perturbation, structural
from .perturbation import draw

# Classes in the order in which they are looked for, their shares, and what a slot may be used for.
CLASSES = ("fine_grained", "placebo", "coarse_grained")
SHARES = {"placebo": 0.2, "fine_grained": 0.5, "coarse_grained": 0.3}
ALLOWED = {
    "data_reference": ("data_reference", ("fine_grained", "placebo")),
    "parameter": ("parameter", ("fine_grained", "placebo")),
    "tool_selection": ("tool_selection", ("fine_grained", "coarse_grained")),
    "structural": ("structural", ("coarse_grained",)),
}
DATA_TYPES = ("wrong_value", "off_by_one", "typo_in_id")
PARAMETER_TYPES = ("threshold_shift", "query_drift", "wrong_parameter")
NEW_POSITION, NEW_FAMILY, CRITICAL = 0.3, 0.2, 0.6
CANDIDATE = "struct<step_index:int,slot:string,value_type:string,value:string,position:string,families:array<string>,classes:array<string>,score:double>"


def _list(names: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, names))


def _union(allowed: Column, of: dict[str, tuple[str, ...]], order: tuple[str, ...]) -> Column:
    held = {name: [a for a, names in of.items() if name in names] for name in order}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(allowed, _list(a)), name) for name, a in held.items() if a]))


def with_candidates(trajectories: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds ``candidates``, best first: slots by what they allow, then ends, plans and tools of whole steps, each in the order of steps.

    A score is the step's criticality (a half if unknown), 0.3 for its part of the trajectory and 0.2 for each family.
    """
    families = _union(F.col("allowed"), {a: (f,) for a, (f, _) in ALLOWED.items()}, tuple(f for f, _ in ALLOWED.values()))
    classes = _union(F.col("allowed"), {a: c for a, (_, c) in ALLOWED.items()}, CLASSES)
    own = slots.withColumns({"families": families, "classes": classes}).filter(F.size("classes") > 0)
    per = own.groupBy("trajectory_id").agg(F.collect_list(F.struct("step_index", "slot", "value_type", "value", "families", "classes")).alias("_slots"))
    n = F.size("steps")

    def candidate(index: Column, slot: Column, kind: Column, value: Column, families: Column, classes: Column) -> Column:
        step = F.get(F.filter("steps", lambda s: s["step_index"] == index), 0)
        score = F.coalesce(step["critical_path_score"], F.lit(0.5)) + NEW_POSITION + NEW_FAMILY * F.size(families)
        parts = (index.cast("int"), slot, kind, value, position_by_thirds(index, n), families, classes, score.cast("double"))
        names = ("step_index", "slot", "value_type", "value", "position", "families", "classes", "score")
        return F.struct(*[p.alias(c) for p, c in zip(parts, names, strict=True)])

    def whole(keep, slot: str, kind: str, value, family: str) -> Column:
        return F.transform(F.filter("steps", keep), lambda s: candidate(s["step_index"], F.lit(slot), F.lit(kind), value(s), _list([family]), _list(["coarse_grained"])))

    ends = lambda s: ~F.coalesce(s["is_terminal_step"], F.lit(False)) & (F.coalesce(s["has_artifacts"], F.lit(False)) | F.coalesce(s["step_role"].isin(*structural.RESULT_ROLES), F.lit(False)))
    plans = lambda s: (F.coalesce(s["critical_path_score"], F.lit(0.5)) >= CRITICAL) & (s["step_index"] > 0)
    tools = lambda s: (s["step_role"] == "tool_call") & (F.coalesce(s["tool_name"], F.lit("")) != "")

    def placed(s: Column) -> Column:
        """The called tool comes before its arguments, and these as they are written."""
        step = F.get(F.filter("steps", lambda x: x["step_index"] == s["step_index"]), 0)
        at = F.when(F.startswith(s["slot"], F.lit("tool_arguments.")), json_text.span(step["tool_arguments"], F.slice(json_text.path_parts(s["slot"]), 2, 100))["start"]).otherwise(0)
        return F.struct(s["step_index"].alias("i"), (s["slot"] != "tool_name").alias("later"), at.alias("at"), s["slot"].alias("slot"), s.alias("s"))

    none = F.expr("cast(array() as array<struct<step_index:int,slot:string,value_type:string,value:string,families:array<string>,classes:array<string>>>)")
    ordered = F.transform(F.array_sort(F.transform(F.coalesce("_slots", none), placed)), lambda x: x["s"])
    slotted = F.transform(ordered, lambda s: candidate(s["step_index"], s["slot"], s["value_type"], s["value"], s["families"], s["classes"]))
    every = F.concat(
        *[x.cast(f"array<{CANDIDATE}>") for x in (
            slotted,
            whole(ends, "terminal_flags", "boolean", lambda s: F.lit("false"), "terminal_flag"),
            whole(plans, "step_structure", "structural", lambda s: s["step_index"].cast("string"), "structural"),
            whole(tools, "tool_name", "tool_selection", lambda s: s["tool_name"], "tool_selection"),
        )]
    )
    # By score, of equal scores in the order above.
    best_first = F.transform(F.array_sort(F.transform(every, lambda c, i: F.struct((-F.bround(c["score"], 6)).alias("s"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    return trajectories.join(per, "trajectory_id", "left").withColumn("candidates", best_first).drop("_slots")


def class_targets(count: int, shares: dict[str, float] | None = None) -> dict[str, int]:
    """How many of each class: shares rounded down, one of each from a count of 3 on, what is left to fine ones."""
    shares = SHARES | (shares or {})
    targets = {c: int(count * shares[c]) for c in CLASSES}
    if count >= len(CLASSES):
        targets = {c: max(1, n) for c, n in targets.items()}
    targets["fine_grained"] += max(0, count - sum(targets.values()))
    return targets


def chosen(candidates: Column, count: int, shares: dict[str, float] | None = None) -> Column:
    """array of (candidate, class): best first, each for the first of its classes that wants more; a step again only for a class's last one."""
    targets = class_targets(count, shares)
    none = f"array<struct<candidate:{CANDIDATE},class:string>>"
    start = F.struct(*[F.lit(0).alias(c) for c in CLASSES], F.expr("cast(array() as array<int>)").alias("used"), F.expr(f"cast(array() as {none})").alias("taken"))

    def step(at: Column, c: Column) -> Column:
        wanted = F.coalesce(*[F.when(F.array_contains(c["classes"], k) & (at[k] < targets[k]), k) for k in CLASSES])
        more = F.coalesce(*[F.when(wanted == k, at[k] < targets[k] - 1) for k in CLASSES], F.lit(False))
        take = (F.size(at["taken"]) < count) & wanted.isNotNull() & ~(F.array_contains(at["used"], c["step_index"]) & more)
        return F.struct(
            *[(at[k] + F.coalesce(take & (wanted == k), F.lit(False)).cast("int")).alias(k) for k in CLASSES],
            F.when(take, F.array_append(at["used"], c["step_index"])).otherwise(at["used"]).alias("used"),
            F.when(take, F.array_append(at["taken"], F.struct(c.alias("candidate"), wanted.alias("class")))).otherwise(at["taken"]).alias("taken"),
        )

    return F.aggregate(candidates, start, step, lambda at: at["taken"])


def choices(df: DataFrame, count: int = 3, shares: dict[str, float] | None = None) -> DataFrame:
    """(df's columns without candidates, place, step_index, slot, value_type, value, families, perturbation_class): a row for each choice."""
    columns = [c for c in df.columns if c != "candidates"]
    own = [F.col(f"x.candidate.{c}").alias(c) for c in ("step_index", "slot", "value_type", "value", "families")]
    return df.select(*columns, F.posexplode(chosen(F.col("candidates"), count, shares)).alias("place", "x")).select(*columns, "place", *own, F.col("x.class").alias("perturbation_class"))


def fine(rows: DataFrame, seed: int) -> DataFrame:
    """Choices of the fine class with family, type, new value and method: a family of the slot and a type of it by the hash.

    A type of parameters goes by the slot where the drawn one isn't made for it; a value that doesn't change makes no record.
    """
    slot, value_type, value, key = F.col("slot"), F.col("value_type"), F.col("value"), F.concat_ws(":", "trajectory_id", "place")
    family = structural.chosen(F.col("families"), seed, key, "family")
    drawn = F.when(family == "data_reference", F.get(_list(DATA_TYPES), draw(seed, key, "type", 3))).when(family == "parameter", F.get(_list(PARAMETER_TYPES), draw(seed, key, "type", 3))).when(family == "tool_selection", "near_neighbor_tool")
    threshold, query = perturbation.is_threshold(slot, value_type), perturbation.is_query(slot, value_type)
    fits = F.when(F.col("_drawn") == "threshold_shift", threshold).when(F.col("_drawn") == "query_drift", query).otherwise(F.lit(False))
    by_slot = F.when(threshold, "threshold_shift").when(query, "query_drift").otherwise("wrong_parameter")
    kind = F.when((F.col("perturbation_family") == "parameter") & ~fits, by_slot).otherwise(F.col("_drawn"))
    rows = rows.filter("perturbation_class = 'fine_grained'").withColumns({"perturbation_family": family, "_drawn": drawn}).withColumn("perturbation_type", kind).drop("_drawn")
    # Each is made once, as the value of a row: filters and later columns read it and don't make it again.
    rows = rows.select("*", F.explode(F.array(perturbation.mutated(value_type, value, seed, key))).alias("_typed"))
    of, args = F.col("perturbation_type"), (value_type, value, seed, key)
    neighbour = structural.chosen(structural.near_neighbours(F.lower(value)), seed, key, "near")
    made = F.when(of == "near_neighbor_tool", F.struct(neighbour.alias("value"), F.lit("near_neighbor_swap").alias("method"))).when(of == "query_drift", perturbation.query_drift(value, seed, key)).when(of == "typo_in_id", perturbation.typo_in_id(*args))
    for name, f in (("wrong_value", perturbation.wrong_value), ("off_by_one", perturbation.off_by), ("threshold_shift", perturbation.threshold_shift), ("wrong_parameter", perturbation.wrong_parameter)):
        made = made.when(of == name, f(*args, F.col("_typed")))
    changed = F.filter(F.array(made), lambda m: m["value"].isNotNull() & ~m["value"].eqNullSafe(value))
    columns = [x for x in rows.columns if x != "_typed"]
    return rows.select(*columns, F.explode(changed).alias("_made")).select(*columns, F.col("_made.value").alias("_new"), F.col("_made.method").alias("mutation_method"))


def generated(trajectories: DataFrame, slots: DataFrame, count: int = 3, shares: dict[str, float] | None = None, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Records of all classes with their perturbed steps: trajectory_id, benchmark, steps, place, the record's fields, undo, perturbed_steps, perturbation_id.

    Placebos change the step's words or the blanks of its arguments; coarse ones are raced over the whole trajectory.
    """
    rows = choices(with_candidates(trajectories, slots), count, shares)
    slot, steps = F.col("slot"), F.col("steps")
    own = F.get(F.filter(steps, lambda s: s["step_index"] == F.col("step_index")), 0)
    none = F.lit(None).cast(structural.UNDO)
    columns = [*trajectories.columns, "place", "perturbation_class", "perturbation_family", "perturbation_type", "target_step_index", "target_slot", "original_value", "perturbed_value", "mutation_method", "undo", "perturbed_steps"]
    inside = F.startswith(slot, F.lit("tool_arguments."))
    before = F.when(inside, json_text.value_at(own["tool_arguments"], F.slice(json_text.path_parts(slot), 2, 100))).otherwise(F.col("value"))
    # In arguments a text stays a text, and what is no number or truth value any more becomes one.
    bare = ~F.startswith("_own", F.lit('"')) & F.col("_new").rlike(r"^(?:true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$")
    finer = fine(rows, seed).withColumn("_own", before).withColumns({"target_step_index": F.col("step_index"), "target_slot": slot, "original_value": F.col("_own"), "perturbed_value": F.when(inside & ~bare, json_text.quoted(F.col("_new"))).otherwise(F.col("_new")), "undo": none})
    finer = finer.withColumn("perturbed_steps", structural.with_slot(steps, F.col("step_index"), slot, F.col("perturbed_value"))).select(*columns)
    key = F.concat_ws(":", "trajectory_id", "place")
    words = F.col("value_type").isin("string", "search_query")
    placebo = rows.filter("perturbation_class = 'placebo'").withColumns({"_text": own["raw_text"], "_arguments": own["tool_arguments"]})
    # An outside paraphrase isn't at hand here, so words of a text are always synonyms.
    in_text = words | F.col("_arguments").isNull()
    placebo = placebo.withColumns(
        {
            "perturbation_type": F.when(in_text, "synonym").otherwise("formatting"), "perturbation_family": F.when(in_text, "data_reference").otherwise("parameter"), "target_step_index": F.col("step_index"),
            "target_slot": F.when(in_text, "raw_text").otherwise("tool_arguments"), "original_value": F.when(in_text, F.col("_text")).otherwise(F.col("_arguments")),
            "perturbed_value": F.when(in_text, perturbation.with_synonyms(F.col("_text"))).otherwise(perturbation.reformatted(F.col("_arguments"))),
            "mutation_method": F.when(in_text, "synonym_substitution").otherwise("heuristic_json_formatting"), "undo": none,
        }
    ).filter("perturbed_value is not null")
    placebo = placebo.withColumn("perturbed_steps", structural.with_slot(steps, F.col("step_index"), F.col("target_slot"), F.col("perturbed_value"))).select(*columns)
    coarse = structural.coarse(rows.filter("perturbation_class = 'coarse_grained'").select(*trajectories.columns, "place"), seed, weights, key=key).select(*columns)
    return finer.unionByName(placebo).unionByName(coarse).withColumn("perturbation_id", structural.perturbation_id())
