"""Checks of perturbation records with their trajectories: named, with severities, of which only errors decide the status.

Rows: a record's fields, perturbed_steps (array of steps) and, for the impact, the original step's critical_path_score,
affects_final_answer and recoverable_if_wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import impact_from_criticality
from .perturbation import FAMILIES, PLACEBO_TYPES, TYPES, valid_pair, valid_type

# Fields that a record must have, roles and classes of the rules.
REQUIRED = ("perturbation_id", "original_trajectory_id", "generation_timestamp", "perturbation_class", "perturbation_family", "perturbation_type", "target_step_index", "target_slot", "mutation_method")
ALL_FAMILIES = tuple(dict.fromkeys(f for families in FAMILIES.values() for f in families))
ALL_TYPES = tuple(dict.fromkeys([*(t for types in TYPES.values() for t in types), *PLACEBO_TYPES]))
TOOL_RULE = {"near_neighbor_tool": "fine_grained", "wrong_tool_family": "coarse_grained"}
NUMBERS, PATHS, TOOLS = r"\b\d+(?:\.\d+)?\b", r"(?:/[\w.-]+)+(?:\.\w+)?", r"\b(?:read|write|search|grep|find|cat|ls|git|bash|execute|submit)\b"


def _check(name: str, passed: Column, severity: str = "error", applies: Column | None = None) -> Column:
    row = F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(severity).alias("severity"))
    return row if applies is None else F.when(F.coalesce(applies, F.lit(False)), row)


def same_marks(before: Column, after: Column, pattern: str) -> Column:
    """Both texts have the same different matches of a pattern; null has none."""
    of = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))))
    return of(before) == of(after)


def same_value(before: Column, after: Column) -> Column:
    """Equal, or equal but for case and blanks around; null is like null alone."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(before.isNull() | after.isNull(), before.isNull() & after.isNull()).otherwise(plain(before) == plain(after))


def schema_checks() -> list[Column]:
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | blank(c)
    return [
        _check("schema_required_fields", ~missing),
        _check("schema_perturbation_class", F.col("perturbation_class").isin(*FAMILIES)),
        _check("schema_perturbation_family", F.col("perturbation_family").isin(*ALL_FAMILIES)),
        _check("schema_perturbation_type", F.col("perturbation_type").isin(*ALL_TYPES)),
        _check("schema_target_step_index", F.col("target_step_index") >= 0),
    ]


def diff_checks() -> list[Column]:
    """A placebo keeps numbers, tools and paths; anything else changes its value."""
    before, after = F.col("original_value"), F.col("perturbed_value")
    placebo = F.coalesce((F.col("perturbation_class") == "placebo") | F.col("perturbation_type").isin(*PLACEBO_TYPES), F.lit(False))
    low = lambda c: F.lower(c)
    return [
        _check("diff_placebo_numbers", same_marks(before, after, NUMBERS), "warning", placebo),
        _check("diff_placebo_tools", same_marks(low(before), low(after), TOOLS), "warning", placebo),
        _check("diff_placebo_filepaths", same_marks(before, after, PATHS), "warning", placebo),
        _check("diff_content_changed", ~same_value(before, after), "error", ~placebo),
    ]


def coherence_checks(steps: Column) -> list[Column]:
    """Fields, order, tools and texts of all steps; without steps only that."""
    some = F.coalesce(F.size(steps) > 0, F.lit(False))
    none_is = lambda bad: ~F.exists(steps, lambda s: F.coalesce(bad(s), F.lit(True)))
    indexes = F.transform(steps, lambda s: s["step_index"])
    empty = lambda c: F.coalesce(c, F.lit("")).rlike(r"^\s*\z")
    return [
        _check("coherence_has_steps", some),
        _check("coherence_step_fields", none_is(lambda s: s["step_index"].isNull() | s["step_role"].isNull() | s["raw_text"].isNull()), "error", some),
        _check("coherence_sequential_indices", F.array_sort(indexes) == F.sequence(F.lit(0), F.size(steps) - 1), "warning", some),
        _check("coherence_tool_names", none_is(lambda s: (F.coalesce(s["step_role"], F.lit("")) == "tool_call") & (F.coalesce(s["tool_name"], F.lit("")) == "")), "warning", some),
        _check("coherence_no_empty", none_is(lambda s: empty(s["raw_text"])), "warning", some),
    ]


def taxonomy_checks() -> list[Column]:
    cls, family, kind = F.col("perturbation_class"), F.col("perturbation_family"), F.col("perturbation_type")
    known = F.coalesce(cls.isin(*FAMILIES) & family.isin(*ALL_FAMILIES) & kind.isin(*ALL_TYPES), F.lit(False))
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOL_RULE.items() for x in kv]), kind)
    return [
        _check("class_family_enum_parse", F.lit(False), "error", ~known),
        _check("class_family_combination", valid_pair(cls, family), "error", known),
        _check("family_type_combination", valid_type(family, kind), "error", known),
        _check("tool_selection_class_rule", cls == wanted, "error", known & (family == "tool_selection") & wanted.isNotNull()),
    ]


def checked(df: DataFrame) -> DataFrame:
    """Adds checks (array of name, passed, severity), generation_status, checks_passed, checks_failed, warnings and expected_impact.

    invalid: a schema error, or nothing changed; borderline: an error of coherence, of class and family or of the tool rule;
    else valid. Warnings, and a type that isn't of its family, leave the status as it is.
    """
    rows = df.withColumn("checks", F.array_compact(F.array(*schema_checks(), *diff_checks(), *coherence_checks(F.col("perturbed_steps")), *taxonomy_checks())))
    failed = F.filter("checks", lambda c: ~c["passed"])
    errors = lambda *starts: F.exists(failed, lambda c: (c["severity"] == "error") & c["name"].rlike("^(?:" + "|".join(starts) + ")"))
    status = F.when(errors("schema_", "diff_content_changed"), "invalid").when(errors("coherence_", "class_family", "tool_selection"), "borderline").otherwise("valid")
    names = lambda c: F.transform(c, lambda x: x["name"])
    placebo_type = F.when(F.col("perturbation_type").isin(*PLACEBO_TYPES), F.lit("placebo")).otherwise(F.col("perturbation_class"))
    impact = impact_from_criticality(F.col("critical_path_score"), F.col("affects_final_answer"), F.col("recoverable_if_wrong"), placebo_type)
    return rows.withColumns(
        {
            "generation_status": status,
            "checks_passed": names(F.filter("checks", lambda c: c["passed"])),
            "checks_failed": names(failed),
            "warnings": names(F.filter(failed, lambda c: c["severity"] == "warning")),
            "expected_impact": impact,
        }
    )


def check_rows(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., name, passed, severity): a row a check."""
    return checked(df).select(*keys, F.explode("checks").alias("c")).select(*keys, "c.*")


def step_changes(before: Column, after: Column) -> Column:
    """array of (kind, step_index, fields) between two step arrays, by index: removed, added, or changed with the names of the fields that differ."""
    fields = ("step_role", "raw_text", "tool_name", "tool_arguments", "observation", "is_terminal_step", "produces_final_answer")
    of = lambda steps: F.map_from_entries(F.transform(steps, lambda s: F.struct(s["step_index"], s)))

    def change(olds: Column, news: Column) -> Column:
        keys = F.array_sort(F.array_union(F.map_keys(olds), F.map_keys(news)))

        def one(i: Column) -> Column:
            a, b = F.element_at(olds, i), F.element_at(news, i)
            differing = F.array_compact(F.array(*[F.when(~a[f].eqNullSafe(b[f]), f) for f in fields]))
            nothing = F.expr("cast(array() as array<string>)")
            made = lambda kind, names: F.struct(F.lit(kind).alias("kind"), i.alias("step_index"), names.alias("fields"))
            return F.when(b.isNull(), made("removed", nothing)).when(a.isNull(), made("added", nothing)).when(F.size(differing) > 0, made("changed", differing))

        return F.array_compact(F.transform(keys, one))

    return F.get(F.transform(F.array(F.struct(of(before).alias("a"), of(after).alias("b"))), lambda m: change(m["a"], m["b"])), 0)


def only_target(changes: Column, index: Column, *fields: str) -> Column:
    """Whether a change of the target step in these fields, or fewer, is all there is."""
    allowed = F.array(*map(F.lit, fields))
    return (F.size(changes) == 1) & F.forall(changes, lambda c: (c["kind"] == "changed") & (c["step_index"] == index) & (F.size(F.array_except(c["fields"], allowed)) == 0))
