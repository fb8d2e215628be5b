"""Step typing over exploded steps: roles, flags, entities, artifacts, dependencies, closure, slots, criticality.

Steps are rows (trajectory_id, step_index from 1, raw_text, tool_name, tool_arguments JSON,
observation, step_type, benchmark).  Trajectories are short, so windows and pair joins
inside one are small, and a corpus is as many of them as there are keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from pyspark.sql import types as T

# Tool sets, role phrases and role scores.
FINISH_TOOLS = ("finish", "submit", "give_answer", "submit_answer", "final_answer")
PATCH_TOOLS = ("str_replace_editor", "file_edit", "patch", "apply_patch", "edit_file", "write")
READ_TOOLS = ("view", "view_file", "file_view", "read", "open", "cat", "search", "find", "list", "ls", "grep")
EXECUTE_TOOLS = ("bash", "run_tests", "pytest", "python", "execute")
PATCH_COMMANDS = ("str_replace", "create", "insert")
EXTRACTION = r"(?i)(?:answer|result|value|found|is|equals?|=)\s*[:=]?\s*\(?(\d+(?:\.\d+)?)\)?|line\s*(\d+)|(?:file|path)\s*[:=]?\s*['\"]?([/\w.-]+)['\"]?|\((\d+(?:\.\d+)?)\)"
PLANNING = r"(?i)i will|let me|first|next|then|plan|approach|strategy|step\s*\d+|need to|should|must|going to|break down|decompose|divide"
DECISION = r"(?i)i choose|i select|decided to|choosing|selecting|the best|the correct|the right|should use"
REASONING = r"(?i)because|therefore|thus|hence|so|since|as a result|this means|this indicates|this suggests|compare|calculate|compute|determine|analyze|evaluate"
CRITICALITY = {"planning": 0.8, "decision": 0.75, "tool_call": 0.7, "extraction": 0.85, "reasoning": 0.5, "observation": 0.3, "final_response": 1.0}
SILENT_ROLES = ("extraction",)
FINAL_ROLES = ("extraction", "final_response")
DIAGNOSIS = r"(?i)bug|issue|problem|error|fix|cause"


def _by():
    return Window.partitionBy("trajectory_id")


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def argument(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("tool_arguments"), f"$.{name}", "string")


def command() -> Column:
    tagged = F.nullif(F.regexp_extract(F.coalesce(argument("raw"), F.lit("")), r"<parameter=command>(\w+)</parameter>", 1), F.lit(""))
    return F.coalesce(F.nullif(argument("command"), F.lit("")), tagged, F.lit(""))


def segmented(steps: Column) -> Column:
    """Each raw step as up to three: a thought of more than 10 characters, its action, its observation."""
    part = lambda s, kind, text, tool, args, out: F.struct(F.lit(kind).alias("segmented_from"), text.alias("raw_text"), tool.alias("tool_name"), args.alias("tool_arguments"), out.alias("observation"))
    none = F.lit(None).cast("string")
    has = lambda c: F.coalesce(c, F.lit("")) != ""

    def parts(s: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(F.length(strip(s["content"])) > 10, part(s, "thought", s["content"], none, none, none)),
                F.when(has(s["tool_name"]), part(s, "action", F.coalesce(s["tool_input"], F.lit("")), s["tool_name"], s["tool_input"], none)),
                F.when(has(s["tool_output"]), part(s, "observation", s["tool_output"], s["tool_name"], none, s["tool_output"])),
            )
        )

    return F.flatten(F.transform(steps, parts))


def step_role() -> Column:
    """By an ordered cascade; any tool that doesn't finish is a call, also on a row cut from an observation."""
    tool, text = low("tool_name"), F.coalesce("raw_text", F.lit(""))
    finish = tool.isin(*FINISH_TOOLS) | F.contains(tool, F.lit("finish"))
    observed = (low("step_type") == "observation") | ((F.coalesce("observation", F.lit("")) != "") & (tool == ""))
    return (
        F.when(finish, "final_response")
        .when(tool != "", "tool_call")
        .when(observed, "observation")
        .when(text.rlike(EXTRACTION), "extraction")
        .when(text.rlike(PLANNING) & (F.col("step_index") <= 2), "planning")
        .when(text.rlike(DECISION), "decision")
        .when(text.rlike(REASONING), "reasoning")
        .when(F.col("step_type") == "tool_execution", "tool_call")
        .when(F.col("step_type") == "planning", "planning")
        .otherwise("reasoning")
    )


def with_extraction(df: DataFrame) -> DataFrame:
    """Adds extracted_value, value_type, source_step, confidence; an extraction without value and source is reasoning.

    A value of 0 counts as none, so a line number or path after it takes its place.
    """
    text = F.coalesce("raw_text", F.lit(""))
    group = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    number, line, path = group(r"\((\d+(?:\.\d+)?)\)"), group(r"(?i)line\s*(\d+)"), group(r"(?i)(?:file|path)\s*[:=]?\s*['\"]?([/\w.-]+\.\w+)['\"]?")
    zero = lambda c: c.try_cast("double") == 0
    value = F.when(number.isNotNull() & ~zero(number), number).when(line.isNotNull() & ~zero(line), line).when(path.isNotNull(), path).otherwise(F.coalesce(line, number))
    kind = F.when(value == number, F.when(F.contains(number, F.lit(".")), "float").otherwise("integer")).when(value == line, "line_number").when(value == path, "filepath")
    source = F.last(F.when(F.coalesce("observation", F.lit("")) != "", F.col("step_index")), ignorenulls=True).over(_by().orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1))
    ex = F.col("step_role") == "extraction"
    out = df.withColumns({"extracted_value": F.when(ex, value), "value_type": F.when(ex, kind), "source_step": F.when(ex, source)})
    grounded = F.col("extracted_value").isNotNull() & F.col("value_type").isNotNull() & F.col("source_step").isNotNull()
    confidence = F.lit(0.3) + 0.3 + F.when(F.col("source_step").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("value_type").isNotNull(), 0.2).otherwise(0.0)
    return out.withColumns({"extraction_confidence": F.when(F.col("extracted_value").isNotNull(), confidence), "step_role": F.when(ex & ~grounded, "reasoning").otherwise(F.col("step_role"))})


def with_flags(df: DataFrame) -> DataFrame:
    """Adds is_terminal_step, produces_final_answer, produces_patch and normalized_operation."""
    tool, cmd = low("tool_name"), command()
    bash = F.lower(F.coalesce(argument("bash_command"), F.lit("")))
    finish = F.contains(tool, F.lit("finish"))
    editor = tool.isin(*PATCH_TOOLS) | F.contains(tool, F.lit("edit"))
    has = lambda name: argument(name).isNotNull()
    patch = (has("old_str") & has("new_str")) | cmd.isin(*PATCH_COMMANDS) | (has("bash_command") & bash.rlike(">|echo|sed|patch|cp|mv"))
    operation = (
        F.when(cmd == "view", "read")
        .when(cmd.isin(*PATCH_COMMANDS), "write")
        .when(tool.isin(*FINISH_TOOLS), "submit")
        .when(tool.isin(*EXECUTE_TOOLS), F.when(bash.rlike(">|echo|sed|patch"), "write").otherwise("execute"))
        .when(tool.isin(*READ_TOOLS), "read")
        .when(editor, "write")
        .when((tool == "") | F.col("step_role").isin("planning", "reasoning", "extraction", "decision"), "reason")
        .when(F.col("step_role") == "tool_call", "execute")
        .otherwise("reason")
    )
    return df.withColumns(
        {
            "is_terminal_step": finish | (F.col("step_index") == F.max("step_index").over(_by())),
            "produces_final_answer": finish & ((F.coalesce(argument("return_type"), F.lit("")) == "give_answer") | has("final_answer")),
            "produces_patch": F.coalesce((F.col("benchmark") == "swebench") & (cmd != "view") & ~tool.isin(*READ_TOOLS) & editor & patch, F.lit(False)),
            "normalized_operation": operation,
        }
    )


#: Families of entities (pattern, at most so many).
ENTITIES = (
    (r"(?:/[\w.-]+)+(?:\.\w+)?", 50),
    (r"\b[a-z_][a-z0-9]*_[a-z0-9_]+\b", 20),
    (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 20),
    (r"https?://[^\s'\"<>]+", 10),
    (r"['\"]([^'\"]{3,50})['\"]", 5),
)


def entities() -> Column:
    """Sorted distinct entities of text and arguments."""
    text = F.concat_ws(" ", "raw_text", "tool_arguments")
    parts = [F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1 if "(" in p.replace("(?:", "") else 0))), 1, n) for p, n in ENTITIES]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*parts), strip)))


#: Tool words and the artifact they make.
TOOL_ARTIFACTS = {
    "edit": "patch", "str_replace": "patch", "str_replace_editor": "patch", "patch": "patch", "write": "patch", "file_edit": "patch",
    "bash": "text", "run": "text", "execute": "text", "test": "text",
}
#: Words of tools that only read.
READ_WORDS = ("view", "file_view", "read", "open", "cat", "search", "find", "list", "ls", "tree", "grep", "rg", "ag", "head", "tail", "less", "more")


def produced_artifacts() -> Column:
    """array<struct<name, artifact_type>> by rules in order; tools that only read make none."""
    tool, out = low("tool_name"), F.coalesce("observation", F.lit("")) != ""
    one = lambda kind, name=None: F.struct(F.concat(F.lit(f"{name or kind}_"), F.col("step_index")).alias("name"), F.lit(kind).alias("artifact_type"))
    by_tool = F.when(F.lit(False), one("text"))
    for word, kind in TOOL_ARTIFACTS.items():
        if kind != "patch":
            by_tool = by_tool.when(F.contains(tool, F.lit(word)), one(kind))
    first = F.when(F.col("produces_patch"), one("patch")).otherwise(F.coalesce(by_tool, F.when((F.col("step_role") == "tool_call") & out, one("api_response"))))
    path = F.coalesce(argument("path"), argument("file"))
    numeric = (F.col("step_role") == "extraction") & F.col("value_type").isin("integer", "float")
    diagnosis = F.col("step_role").isin("reasoning", "extraction") & F.coalesce(F.col("raw_text").rlike(DIAGNOSIS), F.lit(False))
    found = F.array_compact(
        F.array(
            first,
            F.when(path.isNotNull() & F.col("produces_patch"), one("filepath")),
            F.when(F.coalesce(F.col("raw_text").rlike(r"(?i)line\s*\d+"), F.lit(False)), one("line_number")),
            F.when(numeric, one("numeric_answer")),
            F.when(diagnosis, one("diagnosis")),
            F.when(F.col("produces_final_answer"), one("text", "final_answer")),
        )
    )
    reads = F.coalesce(tool.rlike("|".join(READ_WORDS)), F.lit(False))
    fallback = F.when(out, F.array(one("text", "output"))).otherwise(F.slice(F.array(one("text")), 1, 0))
    return F.when(reads, F.slice(F.array(one("text")), 1, 0)).when(F.size(found) > 0, found).otherwise(fallback)


def with_consumed(df: DataFrame) -> DataFrame:
    """Adds consumed_artifacts: earlier paths or numbers that the text may mean, and what its source step made."""
    made = df.select(F.col("trajectory_id").alias("t"), F.col("step_index").alias("at"), F.explode("produced_artifacts.name").alias("name"))
    text = F.coalesce("raw_text", F.lit(""))
    uses_path = text.rlike(r"(?:/[\w.-]+)+(?:\.\w+)?") & (F.col("at") < F.col("step_index")) & F.contains("name", F.lit("filepath"))
    uses_number = text.rlike(r"\((\d+(?:\.\d+)?)\)") & (F.col("at") < F.col("step_index")) & F.contains("name", F.lit("numeric_answer"))
    own = df.select("trajectory_id", "step_index", "raw_text", "source_step")
    both = own.join(made, (F.col("trajectory_id") == F.col("t")) & (F.col("at") <= F.col("step_index")))
    hits = both.filter(uses_path | uses_number | F.coalesce(F.col("at") == F.col("source_step"), F.lit(False)))
    per = hits.groupBy("trajectory_id", "step_index").agg(F.array_sort(F.collect_set("name")).alias("consumed_artifacts"))
    return df.join(per, ["trajectory_id", "step_index"], "left").withColumn("consumed_artifacts", F.coalesce("consumed_artifacts", F.expr("cast(array() as array<string>)")))


#: Path prefixes that are no files, and words that are no entities.
BAD_PATHS = r"^/(?:function|parameter|encrypted-tbn0\.gstatic\.com|images|www|http|https)|^/testbed$|^/usr/bin/env$"
BLOCKED = (
    "/function", "/parameter", "function", "parameter", "file_edit", "file_view", "str_replace_editor", "edit", "file", "view", "search_code", "view_file", "bash", "submit",
    "/testbed", "testbed", "raw", "content", "command", "path", "old_str", "new_str", "result", "response", "output", "input", "value", "data", "error", "success", "true", "false",
)
PLAN_WORDS = r"(?i)(?:as\s+)?(?:planned|intended|mentioned)|next|continuing|following"
VALUE_WORDS = r"(?i)(?:extract|found|got|obtained|retrieved)\s+(?:value|number|result)|(?:answer|value|result)\s+(?:is|was|equals?)"


def file_paths() -> Column:
    """Paths of 8 characters and two segments or more, of the arguments and the text."""
    found = F.concat(F.array_compact(F.array(argument("path"), argument("file"))), F.regexp_extract_all(F.coalesce("raw_text", F.lit("")), F.lit(r"(?:/[\w.-]+)+(?:\.\w+)?"), F.lit(0)))
    good = lambda p: (F.length(p) >= 8) & ~p.rlike(BAD_PATHS) & (F.size(F.filter(F.split(p, "/"), lambda s: s != "")) >= 2)
    return F.array_sort(F.array_distinct(F.filter(found, good)))


def dependency_edges(df: DataFrame) -> DataFrame:
    """(trajectory_id, step_index, source_step, type, evidence): one edge at most to each earlier step, by the first rule that holds."""
    cols = df.withColumns({"files": file_paths(), "ents": entities()})
    cur = cols.select("trajectory_id", "step_index", F.coalesce("raw_text", F.lit("")).alias("text"), "consumed_artifacts", "source_step", "files", "ents")
    prev = cols.select(
        F.col("trajectory_id").alias("t"), F.col("step_index").alias("at"), F.col("step_role").alias("p_role"), F.col("produced_artifacts.name").alias("p_names"),
        F.coalesce("tool_name", F.lit("")).alias("p_tool"), F.col("extracted_value").alias("p_value"), F.col("files").alias("p_files"), F.col("ents").alias("p_ents"),
    )
    pair = cur.join(prev, (F.col("trajectory_id") == F.col("t")) & (F.col("at") < F.col("step_index")))
    names = F.array_intersect("consumed_artifacts", "p_names")
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    says = lambda c: F.rlike(F.col("text"), F.concat(F.lit(r"(?i)\b"), quote(c), F.lit(r"\b")))
    by_number = F.rlike(F.col("text"), F.concat(F.lit(r"(?i)step\s*"), F.col("at").cast("string")))
    files_said = F.filter(F.transform("p_files", lambda p: F.substring_index(p, "/", -1)), lambda f: (F.length(f) > 3) & F.contains(F.lower("text"), F.lower(f)))
    textual = F.when(by_number, F.concat(F.lit("step_"), F.col("at"))).when((F.length("p_tool") > 3) & says(F.col("p_tool")), F.concat(F.lit("tool:"), F.col("p_tool"))).when(F.size(files_said) > 0, F.concat(F.lit("file:"), F.get(files_said, 0)))
    shared_files = F.array_intersect("files", "p_files")
    plain = F.filter(F.array_intersect("ents", "p_ents"), lambda e: ~F.lower(e).isin(*BLOCKED) & ~e.rlike(BAD_PATHS))
    tagged = F.filter(
        F.transform(plain, lambda e: F.when(F.contains(e, F.lit("/")) & (F.length(e) > 12) & (F.size(F.filter(F.split(e, "/"), lambda s: s != "")) >= 2), F.concat(F.lit("file_path:"), e)).when(e.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$") & (F.length(e) > 5) & ~F.lower(e).isin("method", "variable"), F.concat(F.lit("symbol:"), e))),
        lambda x: x.isNotNull(),
    )
    reference = F.when(F.col("text").rlike(VALUE_WORDS), "uses_extracted_value_from").when((F.col("p_role") == "planning") | F.col("text").rlike(PLAN_WORDS), "follows_plan_from").otherwise("uses_observation_from")
    edge = lambda kind, evidence: F.struct(kind.alias("type"), evidence.alias("evidence"))
    found = (
        F.when(F.size(names) > 0, edge(F.lit("uses_observation_from"), F.concat(F.lit("artifact:"), F.array_min(names))))
        .when(textual.isNotNull(), edge(reference, F.concat(F.lit("textual:"), textual)))
        .when((F.col("p_role") == "extraction") & (F.col("source_step") == F.col("at")), edge(F.lit("uses_extracted_value_from"), F.concat(F.lit("extracted:"), F.col("p_value"))))
        .when(F.size(shared_files) > 0, edge(F.lit("acts_on_entity_from"), F.concat(F.lit("file_path:"), F.array_min(shared_files))))
        .when(F.size(tagged) >= 2, edge(F.lit("acts_on_entity_from"), F.array_join(F.slice(F.array_sort(tagged), 1, 3), "|")))
    )
    return pair.withColumn("e", found).filter("e is not null").select("trajectory_id", "step_index", F.col("at").alias("source_step"), "e.type", "e.evidence")


def closure(edges: DataFrame, key: str = "trajectory_id", node: str = "step_index", source: str = "source_step") -> DataFrame:
    """(key, node, ancestors): sources always precede their nodes, so one pass in order folds each key's sets.

    A fold per trajectory inside the JVM: no recursion limit and one shuffle, whatever the depth.
    """
    per = edges.groupBy(key, node).agg(F.array_sort(F.collect_set(source)).alias("_d"))
    rows = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(node).alias("n"), F.col("_d").alias("d")))).alias("_s"))
    start = F.expr(f"cast(array() as array<struct<n: {edges.schema[node].dataType.simpleString()}, a: array<{edges.schema[source].dataType.simpleString()}>>>)")

    def step(acc: Column, x: Column) -> Column:
        inherited = F.flatten(F.transform(F.filter(acc, lambda y: F.array_contains(x["d"], y["n"])), lambda y: y["a"]))
        return F.concat(acc, F.array(F.struct(x["n"].alias("n"), F.array_sort(F.array_union(x["d"], inherited)).alias("a"))))

    return rows.select(key, F.explode(F.aggregate("_s", start, step)).alias("x")).select(key, F.col("x.n").alias(node), F.col("x.a").alias("ancestors"))


def closure_recursive(spark, edges_view: str) -> DataFrame:
    """(trajectory_id, node, ancestor) as a recursive query; as many levels as the trajectory of the most dependent steps could have."""
    levels = spark.sql(f"SELECT max(n) AS n FROM (SELECT count(DISTINCT step_index) AS n FROM {edges_view} GROUP BY trajectory_id)").first().n or 1  # one number
    return spark.sql(
        f"""WITH RECURSIVE up(trajectory_id, node, ancestor) MAX RECURSION LEVEL {levels + 1} AS (
              SELECT trajectory_id, step_index, source_step FROM {edges_view}
              UNION ALL
              SELECT u.trajectory_id, u.node, e.source_step FROM up u JOIN {edges_view} e ON u.trajectory_id = e.trajectory_id AND u.ancestor = e.step_index)
            SELECT DISTINCT trajectory_id, node, ancestor FROM up"""
    )


def fan_out(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """(trajectory_id, step_index, fan_out, dependants): 1 for each direct dependant and 0.5 for each that depends only through others."""
    direct = edges.select("trajectory_id", F.col("source_step").alias("of"), "step_index").distinct().withColumn("w", F.lit(1.0))
    every = closed.select("trajectory_id", F.explode("ancestors").alias("of"), "step_index")
    joined = every.join(direct, ["trajectory_id", "of", "step_index"], "left")
    return joined.groupBy("trajectory_id", F.col("of").alias("step_index")).agg(F.sum(F.coalesce("w", F.lit(0.5))).alias("fan_out"), F.count(F.lit(1)).alias("dependants"))


def criticality(role: Column, fan: Column, index: Column, n: Column, terminal: Column, answers: Column) -> Column:
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CRITICALITY.items() for x in kv]), role), F.lit(0.5))
    base = F.when(F.coalesce(terminal | answers, F.lit(False)), F.greatest(base, F.lit(0.95))).otherwise(base)
    base = F.when((role == "extraction") & (fan > 0), F.greatest(base, F.lit(0.9))).otherwise(base)
    score = base * (1 - index / F.greatest(n, F.lit(1)) * 0.1) + F.least(F.lit(0.2), fan * 0.05)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def with_criticality(df: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Adds critical_path_score, affects_final_answer, affects_tool_execution, recoverable_if_wrong, observable_if_wrong, affects_patch."""
    fans = fan_out(edges, closed)
    rows = df.join(fans, ["trajectory_id", "step_index"], "left").join(closed, ["trajectory_id", "step_index"], "left")
    rows = rows.withColumn("fan_out", F.coalesce("fan_out", F.lit(0.0)))
    n = F.count(F.lit(1)).over(_by())
    terminal_at = F.coalesce(F.min(F.when(F.col("is_terminal_step"), F.col("step_index"))).over(_by()), F.max("step_index").over(_by()))
    rows = rows.withColumn("_terminal", terminal_at)
    of_terminal = F.first(F.when(F.col("step_index") == F.col("_terminal"), F.col("ancestors")), ignorenulls=True).over(_by())
    called = df.filter("step_role = 'tool_call'").select("trajectory_id", "step_index")
    feeds = edges.join(called, ["trajectory_id", "step_index"]).select("trajectory_id", F.col("source_step").alias("step_index")).distinct().withColumn("_feeds", F.lit(True))
    rows = rows.withColumn("_up", F.coalesce(F.array_contains(of_terminal, F.col("step_index")), F.lit(False))).join(feeds, ["trajectory_id", "step_index"], "left")
    role, tool = F.col("step_role"), low("tool_name")
    again = (tool != "") & (F.max("step_index").over(Window.partitionBy("trajectory_id", "tool_name")) > F.col("step_index"))
    artifacts = F.exists("produced_artifacts", lambda a: F.contains(a["artifact_type"], F.lit("patch")))
    return rows.withColumns(
        {
            "critical_path_score": criticality(role, F.col("fan_out"), F.col("step_index"), n, F.col("is_terminal_step"), F.col("produces_final_answer")),
            "affects_final_answer": F.col("produces_final_answer") | F.col("_up") | role.isin(*FINAL_ROLES),
            "affects_patch": F.coalesce((F.col("benchmark") == "swebench") & (F.col("produces_patch") | role.isin("extraction", "decision") | artifacts), F.lit(False)),
            "affects_tool_execution": role.isin("tool_call", "planning") | F.coalesce("_feeds", F.lit(False)),
            "recoverable_if_wrong": F.when(F.col("is_terminal_step") | role.isin(*SILENT_ROLES), False).when(again, True).otherwise(~role.isin(*FINAL_ROLES)),
            "observable_if_wrong": (F.coalesce("observation", F.lit("")) != "") | F.col("produces_final_answer") | F.col("produces_patch") | ~role.isin(*SILENT_ROLES),
        }
    ).drop("_terminal", "_up", "_feeds")


def criticality_summary(df: DataFrame) -> DataFrame:
    s = F.col("critical_path_score")
    return df.groupBy("trajectory_id").agg(F.bround(F.avg(s), 3).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.count_if(s >= 0.7).alias("critical"), F.bround(F.avg((s >= 0.7).cast("int")), 3).alias("critical_share"))


#: Argument names and their type, in order; a name matches inside a longer one.
ARGUMENT_TYPES = (
    ("path", "filepath"), ("file", "filepath"), ("filepath", "filepath"), ("filename", "filepath"), ("directory", "filepath"), ("dir", "filepath"), ("line", "line_number"),
    ("line_number", "line_number"), ("start_line", "line_number"), ("end_line", "line_number"), ("query", "search_query"), ("search", "search_query"), ("q", "search_query"),
    ("keyword", "search_query"), ("code", "code_snippet"), ("old_str", "code_snippet"), ("new_str", "code_snippet"), ("content", "code_snippet"), ("command", "string"), ("url", "url"),
    ("endpoint", "api_endpoint"), ("api", "api_endpoint"), ("ip", "ipv4"), ("ip_address", "ipv4"), ("host", "domain"), ("domain", "domain"), ("hostname", "domain"), ("email", "email"),
    ("latitude", "latitude"), ("lat", "latitude"), ("longitude", "longitude"), ("lng", "longitude"), ("lon", "longitude"), ("count", "integer"), ("limit", "integer"), ("top_k", "integer"),
    ("year", "integer"), ("num", "integer"), ("threshold", "float"), ("temperature", "float"), ("name", "identifier"), ("id", "identifier"), ("key", "identifier"), ("function", "identifier"),
    ("class", "identifier"), ("method", "identifier"),
)


def value_type(name: Column, value: Column, kind: Column) -> Column:
    """By the argument's name, else by the value (``kind`` is its JSON type: bool, int, float or string)."""
    lower, number = F.lower(name), value.try_cast("double")
    out = F.when(F.lit(False), "")
    for word, t in ARGUMENT_TYPES:
        out = out.when(F.contains(lower, F.lit(word)), t)
    lat, lng = F.contains(lower, F.lit("lat")), lower.rlike("lng|lon")
    return (
        out.when(kind == "bool", "boolean")
        .when(kind == "int", "integer")
        .when((kind == "float") & lat & number.between(-90, 90), "latitude")
        .when((kind == "float") & lng & number.between(-180, 180), "longitude")
        .when(kind == "float", "float")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), "email")
        .when(value.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"), "domain")
        .when(value.rlike(r"^-?\d{1,3}\.\d+$") & lat, "latitude")
        .when(value.rlike(r"^-?\d{1,3}\.\d+$") & lng, "longitude")
        .when(value.rlike(r"^https?://"), "url")
        .when(value.rlike(r"^[/\\]?[\w.-]+([/\\][\w.-]+)*\.\w{1,6}$"), "filepath")
        .when(value.rlike(r"[{}()\[\];=]|def |class |import "), "code_snippet")
        .otherwise("string")
    )


def slots(df: DataFrame, key: list[str], arguments: str = "tool_arguments") -> DataFrame:
    """(key..., slot, name, value, kind, value_type) of every scalar argument: nested objects by path, the first five of a list.

    Arguments nest to any depth, so they are walked in an Arrow-fed Python step.
    """
    fields = [*[df.schema[k] for k in key], *[T.StructField(n, T.StringType()) for n in ("slot", "name", "value", "kind")]]

    def walk(name, value, path, depth=0):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(k, v, f"{path}.{k}")
        elif isinstance(value, list):
            for i, v in enumerate(value[:5]):
                if isinstance(v, (str, int, float)):
                    yield f"{path}[{i}]", name, v
        elif value is not None:
            yield path, name, value

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    found = json.loads(row[arguments] or "{}")
                except ValueError:
                    found = {}
                for name, value in found.items() if isinstance(found, dict) else ():
                    for slot, own, v in walk(name, value, f"tool_arguments.{name}"):
                        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
                        out.append([*[row[k] for k in key], slot, own, json.dumps(v) if kind != "string" else v, kind])
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    rows = df.select(*key, arguments).mapInPandas(run, T.StructType(fields))
    return rows.withColumn("value_type", value_type(F.col("name"), F.col("value"), F.col("kind")))


def allowed_perturbations(value_type_: Column) -> Column:
    """What may be done to an argument's slot by its type."""
    params = F.array_compact(F.array(F.lit("parameter"), F.lit("data_reference"), F.when(value_type_ == "code_snippet", "structural")))
    return F.when(value_type_ == "tool", F.array(F.lit("tool_selection"))).otherwise(params)


def step_slots(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., slot, value_type, value, allowed) of typed steps: the called tool, its arguments, an extracted value and a final answer."""
    only = lambda kind: F.array(F.lit(kind))
    row = lambda frame, slot, kind, value, allowed: frame.select(*key, F.lit(slot).alias("slot"), kind.alias("value_type"), value.cast("string").alias("value"), allowed.alias("allowed"))
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    tool = row(df.filter((F.col("step_role") == "tool_call") & some(F.col("tool_name"))), "tool_name", F.lit("tool"), F.col("tool_name"), only("tool_selection"))
    own = slots(df, key).withColumn("allowed", allowed_perturbations(F.col("value_type"))).select(*key, "slot", "value_type", "value", "allowed")
    # An empty name leaves the type to the value; text that is a number has no other kind than string.
    by_value = lambda c: value_type(F.lit(""), c.cast("string"), F.lit("string"))
    extracted = df.filter((F.col("step_role") == "extraction") & F.col("extracted_value").isNotNull())
    extracted = row(extracted, "extracted_value", F.coalesce(F.nullif(F.col("value_type"), F.lit("")), by_value(F.col("extracted_value"))), F.col("extracted_value"), only("data_reference"))
    said = strip(F.regexp_extract(F.coalesce("raw_text", F.lit("")), r"(?i)(?:answer|result)\s*[:=]\s*(.+?)(?:\n|$)", 1))
    answer = F.coalesce(argument("final_answer"), F.nullif(said, F.lit("")))
    final = df.filter(F.col("produces_final_answer") & some(answer))
    final = row(final, "final_answer", by_value(answer), answer, only("data_reference"))
    return tool.unionByName(own).unionByName(extracted).unionByName(final)


def get_path(document: str | None, path: str):
    """The value at ``a.b[0].c`` of JSON text, None if there is none."""
    try:
        value = json.loads(document or "null")
        for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
            value = value[int(index)] if index else value[name]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    return value


def with_path_set(df: DataFrame, document: str, path: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the JSON text with the value (JSON) at a row's own path set; key order is kept. Unreadable or missing places leave it as it is."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def one(doc, where, new):
        try:
            root = json.loads(doc)
            steps = [int(i) if i else n for n, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", where)]
            at = root
            for s in steps[:-1]:
                at = at[s]
            at[steps[-1]]  # only places that exist
            at[steps[-1]] = json.loads(new)
            return json.dumps(root, ensure_ascii=False)
        except (ValueError, KeyError, IndexError, TypeError):
            return doc

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [one(d, p, v) for d, p, v in zip(frame[document], frame[path], frame[value])]})

    return df.mapInPandas(run, schema)


def typed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed steps, edges): all passes in order; artifacts are consumed before dependencies are known.

    Steps and edges are used several times, so both are kept once made (spilled to disk where memory is short; a lost part is made again).
    """
    rows = with_extraction(steps.withColumn("step_role", step_role()))
    rows = with_flags(rows)
    rows = with_consumed(rows.withColumn("produced_artifacts", produced_artifacts())).persist()
    edges = dependency_edges(rows).persist()
    return with_criticality(rows, edges, closure(edges)), edges


def typing_errors(steps: DataFrame) -> DataFrame:
    """(trajectory_id, error, step_index): what keeps a trajectory from being typed, the first fault by step, then by name; null ids are one trajectory without a name."""
    n = F.count(F.lit(1)).over(Window.partitionBy("trajectory_id", "step_index"))
    arguments = F.coalesce(strip(F.col("tool_arguments")), F.lit(""))
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("tool_arguments")).startswith("OBJECT"), F.lit(False)) | (arguments == "")
    fault = (
        F.when(F.col("trajectory_id").isNull(), "no trajectory")
        .when(F.col("step_index").isNull(), "no step index")
        .when(n > 1, "repeated step index")
        .when(~readable, "arguments are no object")
        .when(F.coalesce("benchmark", F.lit("")) == "", "no benchmark")
    )
    faulty = steps.withColumn("error", fault).filter("error is not null")
    first = F.min(F.struct(F.coalesce("step_index", F.lit(-1)).alias("i"), F.col("error").alias("e"), F.col("step_index").alias("step_index")))
    return faulty.groupBy("trajectory_id").agg(first.alias("f")).select("trajectory_id", F.col("f.e").alias("error"), F.col("f.step_index").alias("step_index"))


def typed_or_rejected(steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed steps, edges, rejections): trajectories with a fault are left out whole and listed, so that one bad row doesn't stop the rest."""
    rejected = typing_errors(steps)
    bad = rejected.select(F.col("trajectory_id").alias("_bad"))
    rows, edges = typed(steps.filter("trajectory_id is not null").join(bad, F.col("trajectory_id") == F.col("_bad"), "left_anti"))
    return rows, edges, rejected
