"""Entities that a step mentions: paths, URLs, lines, quoted and called names, numbers of its text, tool, arguments and answer.

Arguments are JSON objects of any shape.  They are walked as variants inside the JVM, objects inside objects
and inside lists down to ``DEPTH``, so a step is one row from its JSON to its sorted entities and nothing is
shuffled.  Null, empty and unreadable parts hold none.  An object that repeats a key is unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
# Patterns of paths (whole matches), and of the other families (their first group) with those of any case.
PATHS = (
    rf"(?:/[{_W}.-]+)+(?:\.[{_W}]+)?",
    rf"(?:[A-Za-z]:\\)?(?:\\[{_W}.-]+)+(?:\.[{_W}]+)?",
    rf"[{_W}.-]+(?:/[{_W}.-]+)*\.[{_W}]{{1,6}}",
)
URL = r"(https?://[^\s<>\"')\]]+)"
LINES = (r"(?i)line\s*(\p{Nd}+)", r"(?i)L(\p{Nd}+)", r"(?i):(\p{Nd}+)(?::\p{Nd}+)?\n?$")
NAMES = (
    rf"`([{_W}]+)`",
    rf"def\s+([{_W}]+)",
    rf"class\s+([{_W}]+)",
    rf"'([{_W}]+)'",
    rf'"([{_W}]+)"',
    rf"(?i)(?:api|endpoint|function)[:\s]+['\"]?([{_W}]+)['\"]?",
    rf"(?i)([{_W}]+_for_[{_W}]+)",
)
# A word that the last of these matches is matched whole: found by words, so that a long word is not searched from each of its characters.
_FOR = rf"(?i)[{_W}]_for_[{_W}]"
NUMBERS = (r"\((\p{Nd}+(?:\.\p{Nd}+)?)\)", r"=\s*(\p{Nd}+(?:\.\p{Nd}+)?)", r"(?i)(?:is|equals?|result)\s*[:=]?\s*(\p{Nd}+(?:\.\p{Nd}+)?)")
# Keys whose texts are entities, limits of paths by place, depth and list items walked, longest answer read.
KEYS = ("path", "file", "filepath", "query", "url", "name")
CONTENT, ANSWER, ARGUMENT, ITEM = 50, 20, 10, 5
DEPTH, ITEMS, ANSWER_LENGTH = 3, 10, 2000
# Words and beginnings that are no entities.
BLOCKED = (
    "/function", "/parameter", "function", "parameter", "file_edit", "file_view", "str_replace_editor", "edit", "file", "view", "search_code", "view_file", "bash", "submit",
    "/testbed", "testbed", "raw", "content", "command", "path", "old_str", "new_str", "insert_line", "view_range", "result", "response", "output", "input", "value", "data",
    "error", "success", "failed", "true", "false",
)
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "null", "none", "this", "that", "from", "with", "will", "have")
BARE_PATHS = ("/testbed", "/usr", "/bin", "/tmp", "/var")
BAD_STARTS = ("/function", "/parameter", "/www", "/http", "/https", "/encrypted", "/images")
TOOL_FILLERS = ("for", "the", "and", "api")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _paths(text: Column) -> Column:
    """Matches of ``PATHS``, in order, by expressions that neither recurse with the segments of a path nor start again at each of its characters.

    The first two match alike with possessive repeats. A match of the third runs from the start of a run of joined segments
    to the run's last ending, so a run has one at most.
    """
    first, second, _ = PATHS
    runs = _all(text, rf"[{_W}.-]++(?:/[{_W}.-]++)*+", 0)
    ended = F.transform(runs, lambda r: F.regexp_extract(r, rf"^[{_W}.-](?:[{_W}./-]*[{_W}.-])?\.[{_W}]{{1,6}}", 0))
    return F.concat(*[_all(text, p.replace("]+)+", "]++)++"), 0) for p in (first, second)], F.filter(ended, lambda r: r != ""))


def text_entities(text: Column, limit: Column) -> Column:
    """Entities of one text. Where its distinct paths reach the limit, that many of them are all; else every other family joins them."""
    text = F.coalesce(text, F.lit(""))
    long = lambda p: ((F.length(p) > 3) & F.contains(p, F.lit("/"))) | F.contains(p, F.lit("\\")) | F.contains(p, F.lit("."))
    paths = F.array_distinct(F.filter(_paths(text), long))
    lines = F.transform(F.concat(*[_all(text, p) for p in LINES]), lambda n: F.concat(F.lit("line "), n))
    words = F.when(F.contains(F.lower(text), F.lit("_for_")), F.filter(_all(text, rf"[{_W}]++", 0), lambda w: w.rlike(_FOR))).otherwise(F.expr("cast(array() as array<string>)"))
    rest = F.concat(lines, words, *[_all(text, p) for p in (URL, *NAMES[:-1], *NUMBERS)])
    return F.when(F.size(paths) >= limit, F.slice(paths, F.lit(1), limit)).otherwise(F.concat(paths, rest))


def argument_texts(arguments: Column) -> Column:
    """array<struct<text, most, named>>: every text of a JSON object with its limit of paths, ``named`` where its key says that it is an entity."""
    kind = lambda v, name: F.startswith(F.schema_of_variant(v), F.lit(name))
    get = lambda v, t: F.try_variant_get(v, "$", t)
    one = lambda v, most, named: F.array(F.struct(get(v, "string").alias("text"), F.lit(most).alias("most"), named.alias("named")))
    none = F.expr("cast(array() as array<struct<text: string, most: int, named: boolean>>)")

    def walk(v: Column, depth: int) -> Column:
        if depth > DEPTH:
            return none
        item = lambda x: F.when(kind(x, "STRING"), one(x, ITEM, F.lit(False))).when(kind(x, "OBJECT"), walk(x, depth + 1)).otherwise(none)

        def entry(e: Column) -> Column:
            k, x = e["key"], e["value"]
            listed = F.flatten(F.transform(F.slice(get(x, "array<variant>"), 1, ITEMS), item))
            return F.when(kind(x, "STRING"), one(x, ARGUMENT, k.isin(*KEYS))).when(kind(x, "OBJECT"), walk(x, depth + 1)).when(kind(x, "ARRAY"), listed).otherwise(none)

        return F.flatten(F.transform(F.map_entries(get(v, "map<string,variant>")), entry))

    root = F.try_parse_json(arguments)
    return F.coalesce(F.when(kind(root, "OBJECT"), walk(root, 0)), none)


def is_entity(e: Column) -> Column:
    """Neither too short nor too long, no blocked or stop word, no artefact of markup, no bare root, no long number."""
    low = F.lower(e)
    started = F.lit(False)
    for start in BAD_STARTS:
        started = started | F.startswith(e, F.lit(start))
    short = (F.length(e) < 4) & ~F.contains(e, F.lit("/"))
    return F.length(e).between(2, 200) & ~low.isin(*BLOCKED, *STOP_WORDS) & ~started & ~e.isin(*BARE_PATHS) & ~e.rlike(r"^\p{Nd}{7,}$") & ~short


def step_entities(content: Column, tool_name: Column, tool_arguments: Column, tool_output: Column) -> Column:
    """Sorted distinct entities of a step. An answer of ``ANSWER_LENGTH`` characters or more is not read."""
    tool = F.coalesce(tool_name, F.lit(""))
    parts = F.filter(F.split(tool, "_"), lambda p: (F.length(p) > 2) & ~F.lower(p).isin(*TOOL_FILLERS))
    texts = argument_texts(tool_arguments)
    from_arguments = F.flatten(F.transform(texts, lambda t: F.concat(text_entities(t["text"], t["most"]), F.when(t["named"], F.array(t["text"])).otherwise(F.expr("cast(array() as array<string>)")))))
    answer = F.when(F.length(tool_output) < ANSWER_LENGTH, tool_output)
    found = F.concat(text_entities(content, F.lit(CONTENT)), F.array(tool), parts, from_arguments, text_entities(answer, F.lit(ANSWER)))
    return F.array_sort(F.array_distinct(F.filter(found, is_entity)))
