"""Perturbations of whole trajectories, as records that can be undone: plans, flags, lengths, tools of another family.

A trajectory is a row (trajectory_id, benchmark, steps) with steps an array of ``STEP``. A perturbation is an expression over
the array: struct(record, steps), null where it doesn't apply. Every choice comes from a hash of seed, trajectory and salt.
A record's values are text; ``undo`` keeps what its one slot and value can't tell: another text, a flag, removed steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_text
from .perturbation import draw

STEP = (
    "struct<step_index:int,step_role:string,raw_text:string,tool_name:string,tool_arguments:string,observation:string,is_terminal_step:boolean,"
    "produces_final_answer:boolean,has_artifacts:boolean,critical_path_score:double>"
)
UNDO = f"struct<raw_text:string,produces_final_answer:boolean,removed:array<{STEP}>>"

# Types, their families, equal weights unless others are given.
COARSE = {"false_terminal": "terminal_flag", "premature_termination": "terminal_flag", "wrong_tool_family": "tool_selection", "wrong_plan": "structural"}
COARSE_WEIGHTS = {"false_terminal": 0.25, "premature_termination": 0.25, "wrong_tool_family": 0.25, "wrong_plan": 0.25}
RESULT_ROLES = ("reasoning", "extraction", "decision")
LEAST_STEPS_LEFT = 2
LEAST_ANSWER = 20

# Signs in a plan, in order, and what is done to a plan that has one.
SCOPE_WORDS = ("and", "both", "also", "multiple", "all")
WORD_SWAPS = (
    (("fix", "bug", "error", "issue", "problem"), (("find", "fix"), ("investigate", "patch"), ("diagnose", "address"))),
    (("verify", "check", "confirm", "validate"), (("verify", "assume"), ("check", "proceed with"), ("confirm", "use"))),
)
HASTE_WORDS = ("search", "find", "look", "research")

# Tools by family, and the families that may stand for one.
TOOL_FAMILIES = {
    "file_operations": ("read_file", "write_file", "edit_file", "list_files", "create_file", "delete_file", "file_search", "open_file", "str_replace_editor", "view", "create", "insert"),
    "web_search": ("web_search", "google_search", "search", "browse", "fetch_url", "http_get", "download", "web_browse", "tavily_search", "bing_search", "duck_duck_go"),
    "code_execution": ("execute", "run", "bash", "shell", "python", "exec", "run_python", "execute_command", "terminal", "subprocess"),
    "database": ("query", "sql", "database", "db_query", "select", "insert", "update", "delete", "fetch_data"),
    "api_calls": ("api_call", "http_request", "rest_api", "graphql", "post", "get", "put", "patch", "request"),
    "analysis": ("analyze", "compute", "calculate", "summarize", "extract", "parse", "evaluate", "measure"),
}
OTHER_FAMILIES = {
    "file_operations": ("web_search", "database", "api_calls"),
    "web_search": ("database", "api_calls", "analysis"),
    "code_execution": ("file_operations", "api_calls"),
    "database": ("file_operations", "api_calls", "web_search"),
    "api_calls": ("database", "web_search", "code_execution"),
    "analysis": ("web_search", "database", "code_execution"),
}
#: Parts of a name that tell the family of a tool that isn't listed.
FAMILY_SIGNS = {
    "file_operations": ("file", "read", "write", "edit", "view"),
    "web_search": ("search", "web", "browse", "fetch"),
    "code_execution": ("run", "exec", "bash", "shell", "python"),
    "database": ("query", "sql", "database", "db"),
    "api_calls": ("api", "http", "request", "post", "get"),
}
# Tools that are near each other, by family and by name.
NEAR_FAMILIES = {
    "search": ("grep", "ripgrep", "rg", "ack", "ag", "find", "locate", "search", "web_search", "google_search", "bing_search"),
    "file_read": ("cat", "head", "tail", "less", "more", "read", "view", "read_file", "get_file", "file_content"),
    "file_write": ("write", "write_file", "save", "save_file", "create_file", "echo", "tee"),
    "file_edit": ("edit", "sed", "awk", "patch", "apply_patch", "modify", "str_replace_editor", "edit_file"),
    "execute": ("run", "exec", "execute", "bash", "sh", "shell", "run_command", "execute_command"),
    "list": ("ls", "dir", "list", "list_files", "list_dir", "get_directory", "tree"),
    "api": ("api_call", "http_get", "http_post", "fetch", "request", "curl", "wget"),
}
NEAR_SWAPS = {
    "grep": ("ripgrep", "rg", "ack"), "ripgrep": ("grep", "rg", "ack"), "rg": ("grep", "ripgrep", "ack"), "cat": ("head", "tail", "less"), "head": ("cat", "tail"), "tail": ("cat", "head"),
    "ls": ("dir", "tree", "find"), "find": ("ls", "locate", "grep"), "web_search": ("google_search", "bing_search", "search"), "google_search": ("web_search", "bing_search"),
    "read_file": ("cat", "get_file", "view_file"), "write_file": ("save_file", "create_file"), "execute": ("run", "bash", "shell"), "bash": ("sh", "shell", "execute"),
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


# -- plans ---------------------------------------------------------------------
def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def narrower(plan: Column) -> Column:
    """The plan without the second of two parts: the first "x and y" of a line up to a stop, or else the first "x as well as y", is "x."."""

    def cut(joint: str) -> Column:
        # From a line's start, as any later place in it finds no more; so each line is gone through once.
        pattern = rf"(?dim)^([^\n]+?)\s+{joint}\s+([^\n]+?)(?:\.|(?=\n?\z))"
        around = F.split(plan, pattern, 2)
        return F.when(F.size(around) == 2, F.concat(F.get(around, 0), F.regexp_extract(plan, pattern, 1), F.lit("."), F.get(around, 1)))

    by_and = cut("and")
    return F.when(by_and != plan, by_and).otherwise(F.coalesce(cut("as well as"), plan))


def inferior_plan(plan: Column) -> Column:
    """A plausible but worse plan by the first rule that changes it: narrower, another verb, unchecked, in haste, or a simple approach; null if none does."""

    def swapped(pairs: tuple[tuple[str, str], ...]) -> Column:
        out = plan
        for a, b in pairs:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    low = F.lower(plan)
    hasty = F.when(F.startswith(low, F.lit("quick")), plan).otherwise(F.concat(F.lit("Quickly "), low))
    rules = [(SCOPE_WORDS, narrower(plan)), *[(words, swapped(pairs)) for words, pairs in WORD_SWAPS], (HASTE_WORDS, hasty)]
    def changed(words: tuple[str, ...], new: Column) -> Column:
        return _once(new, lambda n: F.when(_any_in(low, words) & (n != plan), n))

    made = [changed(words, new) for words, new in rules]
    plainly = F.when(~_any_in(low, ("simple", "quick")), F.concat(F.lit("Take a simple approach: "), plan))
    return F.coalesce(*made, plainly)


# -- perturbations of a trajectory ---------------------------------------------
def _perturbed(kind: str, index: Column, slot: str, before: Column, after: Column, method: str, steps: Column, text: Column | None = None, answer: Column | None = None, removed: Column | None = None) -> Column:
    none = lambda kind_: F.lit(None).cast(kind_)
    undo = F.struct(
        (none("string") if text is None else text).alias("raw_text"), (none("boolean") if answer is None else answer).alias("produces_final_answer"),
        (none(f"array<{STEP}>") if removed is None else removed).alias("removed"),
    )
    record = F.struct(
        F.lit("coarse_grained").alias("perturbation_class"), F.lit(COARSE[kind]).alias("perturbation_family"), F.lit(kind).alias("perturbation_type"), index.cast("int").alias("target_step_index"),
        F.lit(slot).alias("target_slot"), before.cast("string").alias("original_value"), after.cast("string").alias("perturbed_value"), F.lit(method).alias("mutation_method"), undo.alias("undo"),
    )
    return F.struct(record.alias("record"), steps.alias("steps"))


def chosen(options: Column, seed: int, key: Column, salt: str) -> Column:
    """One of an array by the hash; null of none."""
    return _once(options, lambda o: F.get(o, draw(seed, key, salt, F.greatest(F.size(o), F.lit(1)))))


def edited(steps: Column, index: Column, change: Callable[[Column], Column]) -> Column:
    """The array with the steps of this index changed."""
    return F.transform(steps, lambda s: F.when(s["step_index"] == index, change(s)).otherwise(s))


def wrong_plan(steps: Column, seed: int, key: Column) -> Column:
    """A planning step has an inferior plan."""

    def made(step: Column) -> Column:
        return _once(inferior_plan(step["raw_text"]), lambda plan: F.when(plan.isNotNull(), _perturbed("wrong_plan", step["step_index"], "raw_text", step["raw_text"], plan, "template_inferior_plan", edited(steps, step["step_index"], lambda s: s.withField("raw_text", plan)))))

    return _once(chosen(F.filter(steps, lambda s: s["step_role"] == "planning"), seed, key, "plan"), made)


def _is_result(step: Column) -> Column:
    return step["step_role"].isin(*RESULT_ROLES) | F.coalesce(step["has_artifacts"], F.lit(False))


def _ends(step: Column) -> Column:
    return step.withField("is_terminal_step", F.lit(True)).withField("produces_final_answer", F.lit(True))


def false_terminal(steps: Column, seed: int, key: Column) -> Column:
    """A step that could pass for a result, whole and not too short, is flagged as the end."""

    def eligible(step: Column) -> Column:
        text = F.regexp_replace(F.coalesce(step["raw_text"], F.lit("")), r"^\s+|\s+$", "")
        return ~F.coalesce(step["is_terminal_step"], F.lit(False)) & _is_result(step) & ~text.rlike(r"(?:\.\.\.|,)\z") & (F.char_length(text) >= LEAST_ANSWER)

    def made(step: Column) -> Column:
        return F.when(step.isNotNull(), _perturbed("false_terminal", step["step_index"], "is_terminal_step", F.lit("false"), F.lit("true"), "false_terminal_flag", edited(steps, step["step_index"], _ends), answer=F.coalesce(step["produces_final_answer"], F.lit(False))))

    return _once(chosen(F.filter(steps, eligible), seed, key, "end"), made)


def premature_termination(steps: Column, seed: int, key: Column, left: int = LEAST_STEPS_LEFT) -> Column:
    """All after a step before the end goes, at best a step that could pass for a result; the last that stays has the flags of an end."""
    n = F.size(steps)
    terminal = F.get(F.filter(steps, lambda s: F.coalesce(s["is_terminal_step"], F.lit(False))), 0)
    last = F.least(F.coalesce(terminal["step_index"], F.element_at(steps, -1)["step_index"]) - 1, n - 1)
    within = F.filter(steps, lambda s: (s["step_index"] >= left - 1) & (s["step_index"] <= last))
    results = F.transform(F.filter(within, _is_result), lambda s: s["step_index"])
    options = F.when(F.size(results) > 0, results).otherwise(F.sequence(F.lit(left - 1), last))

    def made(at: Column) -> Column:
        kept = F.filter(steps, lambda s: s["step_index"] <= at)
        m = F.size(kept)
        ended = F.transform(kept, lambda s, i: F.when(i == m - 1, _ends(s)).otherwise(s))
        # The flags of the last are undone by its own copy, which is the first of what went.
        gone = F.concat(F.slice(kept, -1, 1), F.filter(steps, lambda s: s["step_index"] > at))
        return F.when((m > 0) & at.isNotNull(), _perturbed("premature_termination", at, "trajectory_length", n, m, "premature_truncation", ended, removed=gone))

    return F.when((n >= left + 1) & (last > left - 1), _once(chosen(options, seed, key, "cut"), made))


def tool_family(name: Column) -> Column:
    """Of a tool's name in lower case: as listed (of a tool in two, the later), by a listed name in it or it in one, or by signs in it; null if none."""
    listed = {tool: family for family, tools in TOOL_FAMILIES.items() for tool in tools}
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in listed.items() for x in kv]), name)
    like = [F.when(F.exists(F.array(*map(F.lit, tools)), lambda t: F.contains(name, t) | F.contains(t, name)), family) for family, tools in TOOL_FAMILIES.items()]
    signs = [F.when(_any_in(name, words), family) for family, words in FAMILY_SIGNS.items()]
    return F.coalesce(exact, *like, *signs)


def wrong_tool_family(steps: Column, seed: int, key: Column) -> Column:
    """A call's tool is one of a family that may stand for its own, in the step's text too. The calls are taken in the order of their hashes."""
    named = lambda s: (s["step_role"] == "tool_call") & (F.coalesce(s["tool_name"], F.lit("")) != "")
    order = lambda s: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit("call"), s["step_index"].cast("string")))
    known = F.filter(F.transform(F.filter(steps, named), lambda s: F.struct(order(s).alias("o"), tool_family(F.lower(s["tool_name"])).alias("family"), s.alias("s"))), lambda x: x["family"].isNotNull())
    others = F.create_map(*[x for family, names in OTHER_FAMILIES.items() for x in (F.lit(family), F.array(*map(F.lit, names)))])
    tools = F.create_map(*[x for family, names in TOOL_FAMILIES.items() for x in (F.lit(family), F.array(*map(F.lit, sorted(names))))])

    def made(call: Column) -> Column:
        step = call["s"]

        def swapped(tool: Column) -> Column:
            text = F.replace(step["raw_text"], step["tool_name"], tool)
            new = edited(steps, step["step_index"], lambda s: s.withField("tool_name", tool).withField("raw_text", text))
            return _perturbed("wrong_tool_family", step["step_index"], "tool_name", step["tool_name"], tool, "cross_family_tool_swap", new, text=step["raw_text"])

        family = chosen(F.element_at(others, call["family"]), seed, key, "family")
        return F.when(call.isNotNull(), _once(chosen(F.element_at(tools, family), seed, key, "tool"), swapped))

    return _once(F.get(F.sort_array(known), 0), made)


GENERATORS = {"false_terminal": false_terminal, "premature_termination": premature_termination, "wrong_tool_family": wrong_tool_family, "wrong_plan": wrong_plan}


def raced(weights: dict[str, float], seed: int, key: Column, salt: str = "race") -> Column:
    """The names in a weighted random order without repetition: the arrival times of exponential clocks of these rates. Names of no weight never arrive."""

    def arrival(name: str, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(salt), F.lit(name))), 1, 12)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.struct((-F.log(uniform) / weight).alias("at"), F.lit(name).alias("name"))

    times = F.array(*[arrival(name, w) for name, w in weights.items() if w > 0])
    return F.transform(F.sort_array(times), lambda t: t["name"])


def coarse(df: DataFrame, seed: int = 42, weights: dict[str, float] | None = None, key: Column | None = None) -> DataFrame:
    """A record for each row for which a type applies: the first that does in the order of the race. Rows without one are left out.

    ``key`` tells rows of a trajectory apart, so that each has a race and choices of its own.

    perturbation_id, trajectory_id, benchmark, the record's fields and undo, perturbed_steps; ``steps`` stays.
    """
    key = F.concat(F.col("trajectory_id").cast("string"), F.lit(":")) if key is None else key
    generate = lambda name: F.coalesce(*[F.when(name == kind, f(F.col("steps"), seed, key)) for kind, f in GENERATORS.items()])
    # The first of the race that applies, as a row of its own: what reads it doesn't make it again.
    first = F.slice(F.filter(F.transform(raced(weights or COARSE_WEIGHTS, seed, key), generate), lambda x: x.isNotNull()), 1, 1)
    out = df.select(*df.columns, F.explode(first).alias("_made")).select(*df.columns, "_made.record.*", F.col("_made.steps").alias("perturbed_steps"))
    return out.withColumn("perturbation_id", perturbation_id())


def perturbation_id() -> Column:
    """By what a record is about, so the same one has the same id wherever it is made."""
    parts = F.concat_ws("|", "trajectory_id", "perturbation_type", F.col("target_step_index").cast("string"), "target_slot", F.coalesce("perturbed_value", F.lit("")))
    return F.concat(F.lit("pert_"), F.col("trajectory_id").cast("string"), F.lit("_"), F.substring(F.md5(parts), 1, 8))


# -- a slot's change -----------------------------------------------------------
def with_slot(steps: Column, index: Column, slot: Column, value: Column) -> Column:
    """The steps with a slot of the step of this index set: a field, or a path inside its arguments, where all else stays byte for byte.

    ``value`` is text, in arguments JSON. A slot that a step doesn't have leaves it as it is.
    """
    inside = F.startswith(slot, F.lit("tool_arguments."))
    path = F.slice(json_text.path_parts(slot), 2, 100)

    def change(s: Column) -> Column:
        out = s
        for field in ("raw_text", "tool_name", "tool_arguments", "observation", "step_role"):
            out = out.withField(field, F.when(slot == field, value).otherwise(s[field]))
        for field in ("is_terminal_step", "produces_final_answer"):
            out = out.withField(field, F.when(slot == field, value.try_cast("boolean")).otherwise(s[field]))
        arguments = F.when(inside, json_text.with_value(s["tool_arguments"], path, value)).when(slot == "tool_arguments", value).otherwise(s["tool_arguments"])
        return out.withField("tool_arguments", arguments)

    return edited(steps, index, change)


def without_step(steps: Column, index: Column) -> Column:
    """The steps without one; those after it are numbered anew."""
    kept = F.filter(steps, lambda s: s["step_index"] != index)
    return F.transform(kept, lambda s: s.withField("step_index", F.when(s["step_index"] > index, s["step_index"] - 1).otherwise(s["step_index"])))


def with_step(steps: Column, step: Column) -> Column:
    """The inverse: steps from its index on move up by one, and it stands before the first of them."""
    at = step["step_index"]
    moved = F.transform(steps, lambda s: s.withField("step_index", F.when(s["step_index"] >= at, s["step_index"] + 1).otherwise(s["step_index"])))
    place = F.aggregate(moved, F.struct(F.lit(0).alias("i"), F.lit(-1).alias("hit")), lambda a, s: F.struct((a["i"] + 1).alias("i"), F.when((a["hit"] < 0) & (s["step_index"] > at), a["i"]).otherwise(a["hit"]).alias("hit")), lambda a: F.when(a["hit"] < 0, a["i"]).otherwise(a["hit"]))
    return _once(place, lambda p: F.concat(F.slice(moved, F.lit(1), p), F.array(step), F.slice(moved, p + 1, F.size(moved))))


# -- tools of a catalogue ------------------------------------------------------
def placed_tools(catalogue: DataFrame, buckets: int = 64) -> DataFrame:
    """(tool, family, place, first, size, total) of a catalogue (tool, family) of any size: families one after another, tools in each by hash.

    Places are from ranges: counts of each family's hash buckets are summed, tools ranked inside a bucket, so no task has a whole family.
    """
    tools = catalogue.select("tool", "family").distinct().filter("tool is not null and family is not null").withColumn("bucket", F.conv(F.substring(F.md5("tool"), 1, 2), 16, 10).cast("int") % buckets)
    counts = tools.groupBy("family", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("family").agg(F.sum("n").alias("size"))
    whole = Window.orderBy("family").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a family.
    firsts = sizes.withColumn("first", F.sum("size").over(whole) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy()))
    before = F.sum("n").over(Window.partitionBy("family").orderBy("bucket")) - F.col("n")
    ranked = tools.withColumn("rank", F.row_number().over(Window.partitionBy("family", "bucket").orderBy(F.md5("tool"), "tool")) - 1)
    offsets = counts.withColumn("before", before).drop("n")
    return ranked.join(offsets, ["family", "bucket"]).join(firsts, "family").select("tool", "family", (F.col("first") + F.col("before") + F.col("rank")).alias("place"), "first", "size", "total")


def substituted(asked: DataFrame, catalogue: DataFrame, seed: int, near: bool) -> DataFrame:
    """``asked`` (key, tool) with ``substitute``: by the hash of the key another tool of the same family (``near``) or any of the other families.

    Null where the tool isn't in the catalogue or there is no other. A place is drawn among those allowed and looked up, so no pairs of tools are made.
    """
    placed = placed_tools(catalogue)
    mine = placed.select("tool", F.col("place").alias("own"), "first", "size", "total")
    rows = asked.join(mine, "tool", "left")
    among = F.col("size") - 1 if near else F.col("total") - F.col("size")
    r = draw(seed, F.col("key"), "near" if near else "anti", F.greatest(among, F.lit(1)))
    to = F.col("first") + (F.col("own") - F.col("first") + 1 + r) % F.col("size") if near else F.when(r < F.col("first"), r).otherwise(r + F.col("size"))
    rows = rows.withColumn("_to", F.when(among > 0, to).cast("bigint"))
    return rows.join(placed.select(F.col("place").alias("_to"), F.col("tool").alias("substitute")), "_to", "left").select(*asked.columns, "substitute")


def near_neighbours(name: Column) -> Column:
    """The tools near a tool (lower case): of the family that has its name, or a name in it or that it is in, and its usual swaps; itself not among them. Sorted."""
    families = [F.when(F.array_contains(F.array(*map(F.lit, tools)), name) | F.exists(F.array(*map(F.lit, tools)), lambda t: F.contains(name, t) | F.contains(t, name)), F.array(*map(F.lit, tools))) for tools in NEAR_FAMILIES.values()]
    empty = F.expr("cast(array() as array<string>)")
    swaps = F.try_element_at(F.create_map(*[x for k, v in NEAR_SWAPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), name)
    return F.array_sort(F.filter(F.array_union(F.coalesce(*families, empty), F.coalesce(swaps, empty)), lambda t: t != name))
