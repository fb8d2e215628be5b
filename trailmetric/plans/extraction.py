"""Queries of entities inside nested arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities
from ..sources import table
from .base import rounded

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            S[name] = sql
        return f

    return add


#: Nested arguments of whole texts; every fifth is no JSON, and the innermost object lies deeper than the walk goes.
_ARGUMENTS = """CASE WHEN turn % 5 = 4 THEN text ELSE {object}('path', concat('/srv/', role, '/part_', turn, '.py'), 'note', text, 'size', conv_id,
  'options', {inner}('query', text, 'deep', {inner}('name', concat('get_', role, '_for_', conv_id), 'deeper', {inner}('url', concat('https://example.org/', conv_id, '?q=', turn), 'deepest', {inner}('name', concat('never_seen_', conv_id))))),
  'items', {list}({inner}('file', concat('C:', chr(92), chr(92), 'data', chr(92), role, '.csv'), 'other', concat('line ', turn)), {inner}('file', text, 'other', concat(chr(39), role, '_', turn, chr(39)))),
  'words', split(text, ' ')){end} END"""
_SPARK_ARGUMENTS = _ARGUMENTS.format(object="to_json(named_struct", inner="named_struct", list="array", end=")")
_DUCK_ARGUMENTS = _ARGUMENTS.format(object="CAST(json_object", inner="json_object", list="json_array", end=" AS VARCHAR)")
#: Tool and answer, the same text in both engines.
_TOOL = "CASE WHEN turn % 2 = 1 THEN concat('search_', role, '_for_the_big_', turn) END"
_ANSWER = "CASE WHEN turn % 2 = 1 THEN concat(text, ' = 17 ', text) END"


def _entities_sql() -> str:
    """DuckDB walks the JSON by rows, a level at a time, and finds entities text by text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
    every = lambda p, group=1: f"regexp_extract_all(t, {quoted(p)}, {group})"
    levels = "".join(
        f""", o{d + 1} AS (SELECT o.conv_id, o.turn, e.value AS v FROM o{d} o, json_each(o.v) e WHERE e.type = 'OBJECT'
        UNION ALL SELECT o.conv_id, o.turn, i.value FROM o{d} o, json_each(o.v) e, json_each(e.value) i WHERE e.type = 'ARRAY' AND i.type = 'OBJECT' AND CAST(i.key AS INT) < {entities.ITEMS})"""
        for d in range(entities.DEPTH)
    )
    objects = " UNION ALL ".join(f"SELECT * FROM o{d}" for d in range(entities.DEPTH + 1))
    lines = " || ".join(every(p) for p in entities.LINES)
    rest = " || ".join([f"list_transform({lines}, lambda x: concat('line ', x))", *[every(p) for p in (entities.URL, *entities.NAMES, *entities.NUMBERS)]])
    paths = " || ".join(every(p, 0) for p in entities.PATHS)
    starts = " OR ".join(f"starts_with(e, {quoted(s)})" for s in entities.BAD_STARTS)
    return f"""WITH s AS (SELECT conv_id, turn, text, {_DUCK_ARGUMENTS} AS args, {_TOOL} AS tool, {_ANSWER} AS answer FROM conversations),
    o0 AS (SELECT conv_id, turn, CAST(args AS JSON) AS v FROM s WHERE CASE WHEN json_valid(args) THEN json_type(args) = 'OBJECT' ELSE false END){levels},
    o AS ({objects}),
    texts AS (SELECT conv_id, turn, e.value ->> '$' AS t, {entities.ARGUMENT} AS most, e.key IN {names(entities.KEYS)} AS named FROM o, json_each(o.v) e WHERE e.type = 'VARCHAR'
      UNION ALL SELECT conv_id, turn, i.value ->> '$', {entities.ITEM}, false FROM o, json_each(o.v) e, json_each(e.value) i WHERE e.type = 'ARRAY' AND i.type = 'VARCHAR' AND CAST(i.key AS INT) < {entities.ITEMS}
      UNION ALL SELECT conv_id, turn, text, {entities.CONTENT}, false FROM s
      UNION ALL SELECT conv_id, turn, answer, {entities.ANSWER}, false FROM s WHERE length(answer) < {entities.ANSWER_LENGTH}),
    p AS (SELECT *, list_filter({paths}, lambda x: (length(x) > 3 AND contains(x, '/')) OR contains(x, chr(92)) OR contains(x, '.')) AS found FROM texts),
    q AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS paths FROM p),
    e AS (SELECT conv_id, turn, unnest(CASE WHEN len(paths) >= most THEN paths[1:most] ELSE paths || {rest} END) AS e FROM q
      UNION SELECT conv_id, turn, t FROM texts WHERE named UNION SELECT conv_id, turn, tool FROM s WHERE tool IS NOT NULL
      UNION SELECT conv_id, turn, w FROM (SELECT conv_id, turn, unnest(split(tool, '_')) AS w FROM s) WHERE length(w) > 2 AND lower(w) NOT IN {names(entities.TOOL_FILLERS)}),
    k AS (SELECT conv_id, turn, list_sort(list(DISTINCT e)) AS found FROM e WHERE length(e) BETWEEN 2 AND 200 AND lower(e) NOT IN {names((*entities.BLOCKED, *entities.STOP_WORDS))} AND NOT ({starts})
      AND e NOT IN {names(entities.BARE_PATHS)} AND NOT regexp_full_match(e, '\\p{{Nd}}{{7,}}') AND NOT (length(e) < 4 AND NOT contains(e, '/')) GROUP BY 1, 2)
    SELECT s.conv_id, s.turn, coalesce(len(found), 0) AS n_entities, coalesce(array_to_string(found, '|'), '') AS entities FROM s LEFT JOIN k USING (conv_id, turn)"""


@query("step_entities", _entities_sql())
def step_entities(spark, d):
    """Entities of every turn as a step with nested arguments, over whole texts."""
    steps = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", f"{_SPARK_ARGUMENTS} AS args", f"{_TOOL} AS tool", f"{_ANSWER} AS answer")
    found = steps.select("conv_id", "turn", entities.step_entities(*map(F.col, ("text", "tool", "args", "answer"))).alias("found"))
    return found.select("conv_id", "turn", F.size("found").alias("n_entities"), F.array_join("found", "|").alias("entities"))
