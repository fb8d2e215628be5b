"""Queries of perturbation records, their checks and evaluation units, over conversations as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generation, perturbation, record_checks, structural, typing, units
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


#: A turn as a typed step, the same text in both engines: what it is follows from its text.
STEP = {
    "trajectory_id": "concat('t', conv_id)",
    "step_index": "CAST(turn AS INT)",
    "step_role": "CASE WHEN role = 'user' THEN CASE WHEN turn = 0 THEN 'planning' ELSE 'reasoning' END WHEN length(text) % 3 = 0 THEN 'tool_call' WHEN length(text) % 3 = 1 THEN 'extraction' ELSE 'observation' END",
    "raw_text": "text",
    "tool_name": "CASE WHEN role <> 'user' AND length(text) % 3 = 0 THEN CASE length(text) % 8 WHEN 0 THEN 'bash' WHEN 1 THEN 'Web_Search' WHEN 2 THEN 'read_file' WHEN 3 THEN 'sql_runner' WHEN 4 THEN 'compute' WHEN 5 THEN 'zzz' WHEN 6 THEN 'get_weather' ELSE 'in' END END",
    "tool_arguments": r"""CASE WHEN role <> 'user' AND length(text) % 3 = 0 THEN CASE length(text) % 5
      WHEN 0 THEN concat('{"query": "', regexp_extract(text, '[A-Za-z]+', 0), '",  "top_k" : ', CAST(length(text) AS VARCHAR(20)), ', "opts": {"deep": true, "path": "/src/', regexp_extract(text, '[A-Za-z]+', 0), '.py"}}')
      WHEN 1 THEN concat('{"top_k":', CAST(length(text) AS VARCHAR(20)), ',"opts":{"path":"/a/', regexp_extract(text, '[A-Za-z]+', 0), '.txt","deep":false}}')
      WHEN 2 THEN concat('{"opts": {"path": "/b/c.d/', regexp_extract(text, '[A-Za-z]+', 0), '.md"}, "query": "find ', regexp_extract(text, '[A-Za-z]+', 0), ' now"}')
      WHEN 3 THEN concat('{"opts" : { "deep" : true , "path" : "/x/y.z" } , "top_k" : 0.5}')
      ELSE concat('{"name": "', regexp_extract(text, '[A-Za-z]+', 0), '_7", "opts": {"path": "/q/r.s"}}') END END""",
    "observation": "CASE WHEN role <> 'user' AND length(text) % 3 = 2 THEN text END",
    "is_terminal_step": "turn = max(turn) OVER (PARTITION BY conv_id)",
    "produces_final_answer": "turn = max(turn) OVER (PARTITION BY conv_id) AND role <> 'user'",
    "has_artifacts": "text LIKE '%er %'",
    "critical_path_score": "CAST(length(text) % 10 AS DOUBLE) / 10",
}
STEPS_SQL = f"step AS (SELECT conv_id, {', '.join(f'{e} AS {c}' for c, e in STEP.items())} FROM conversations)"
#: Steps of one row as one text, for a digest; a missing value is a sign of its own.
_SHOWN = "concat_ws('|', CAST({0}step_index AS VARCHAR(20)), coalesce({0}step_role, '~'), coalesce({0}raw_text, '~'), coalesce({0}tool_name, '~'), coalesce({0}tool_arguments, '~'), coalesce({0}observation, '~'), CASE WHEN {0}is_terminal_step THEN 'T' ELSE 'F' END, CASE WHEN {0}produces_final_answer THEN 'T' ELSE 'F' END)"


def shown(steps: str) -> F.Column:
    """MD5 of all steps, in order."""
    return F.expr(f"md5(array_join(transform({steps}, s -> {_SHOWN.format('s.')}), '\\n'))")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajectory_id, benchmark, steps): one row a conversation; a conversation is bounded, so its turns come together."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", *[f"{e} AS {c}" for c, e in STEP.items()])
    fields = [c for c in STEP if c != "trajectory_id"]
    per = rows.groupBy("conv_id", "trajectory_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    benchmark = F.when(F.col("conv_id") % 3 == 0, "swebench").when(F.col("conv_id") % 3 == 1, "gaia").otherwise("toolbench")
    return per.select("conv_id", "trajectory_id", benchmark.alias("benchmark"), F.col("steps").cast(f"array<{structural.STEP}>").alias("steps"))


def _plan_sql(t: str) -> str:
    low = f"lower({t})"
    rules = []
    for joint in ("and", "as well as"):
        new = f"regexp_replace({t}, '(?i)(.+?)\\s+{joint}\\s+(.+?)(?:\\.|$)', '\\1.')"
        rules.append((structural.SCOPE_WORDS, new))
    for words, pairs in structural.WORD_SWAPS:
        new = t
        for x, y in pairs:
            new = f"replace({new}, '{x}', '{y}')"
        rules.append((words, new))
    rules.append((structural.HASTE_WORDS, f"CASE WHEN starts_with({low}, 'quick') THEN {t} ELSE concat('Quickly ', {low}) END"))
    whens = " ".join(f"WHEN regexp_matches({low}, '{'|'.join(words)}') AND {new} <> {t} THEN {new}" for words, new in rules)
    return f"CASE {whens} WHEN NOT regexp_matches({low}, 'simple|quick') THEN concat('Take a simple approach: ', {t}) END"


@query("inferior_plans", f"SELECT conv_id, turn, md5({_plan_sql('text')}) AS plan, {_plan_sql('text')} IS NULL AS none FROM conversations")
def inferior_plans(spark, d):
    plan = structural.inferior_plan(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(plan).alias("plan"), plan.isNull().alias("none"))


def _draw(salt: str, n: str, key: str = "concat(t, ':')", seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {key}, '{salt}')), 1, 8))::BIGINT % ({n}))"


def _arrival(name: str) -> str:
    return f"-ln((('0x' || substr(md5(concat_ws(':', '42', concat(t, ':'), 'race', '{name}')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / 0.25"


def _family_sql(name: str) -> str:
    listed = {tool: family for family, tools in structural.TOOL_FAMILIES.items() for tool in tools}
    exact = " ".join(f"WHEN {name} = '{t}' THEN '{f}'" for t, f in listed.items())
    like = " ".join(f"WHEN {' OR '.join(f'''contains({name}, '{t}') OR contains('{t}', {name})''' for t in tools)} THEN '{f}'" for f, tools in structural.TOOL_FAMILIES.items())
    signs = " ".join(f"WHEN regexp_matches({name}, '{'|'.join(w)}') THEN '{f}'" for f, w in structural.FAMILY_SIGNS.items())
    return f"CASE {exact} {like} {signs} END"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_OTHERS = "CASE family " + " ".join(f"WHEN '{f}' THEN {_list(o)}" for f, o in structural.OTHER_FAMILIES.items()) + " END"
_TOOLS = "CASE other " + " ".join(f"WHEN '{f}' THEN {_list(sorted(o))}" for f, o in structural.TOOL_FAMILIES.items()) + " END"
_RESULT = "(step_role IN ('reasoning', 'extraction', 'decision') OR has_artifacts)"
#: Every type's record of every trajectory, the race, and the first of it that has one.
RECORDS_SQL = rf"""{STEPS_SQL},
s AS (SELECT *, trajectory_id AS t FROM step),
n AS (SELECT t, count(*) AS n, min(step_index) FILTER (WHERE is_terminal_step) AS terminal FROM s GROUP BY 1),
plans AS (SELECT t, list(step_index ORDER BY step_index) AS pos FROM s WHERE step_role = 'planning' GROUP BY 1),
plan AS (SELECT s.t, step_index, raw_text, {_plan_sql("raw_text")} AS plan FROM s JOIN plans p ON p.t = s.t AND s.step_index = p.pos[1 + {_draw("plan", "len(p.pos)", "concat(p.t, ':')")}]),
ends AS (SELECT t, list(step_index ORDER BY step_index) AS pos FROM s WHERE NOT is_terminal_step AND {_RESULT} AND NOT regexp_matches(trim(raw_text, E' \t\n\r\f\x0b'), '(?:\.\.\.|,)\z') AND length(trim(raw_text, E' \t\n\r\f\x0b')) >= 20 GROUP BY 1),
cuts AS (
  SELECT n.t, n.n, least(terminal - 1, n.n - 1) AS last,
         coalesce((SELECT list(step_index ORDER BY step_index) FROM s WHERE s.t = n.t AND {_RESULT} AND step_index BETWEEN 1 AND least(terminal - 1, n.n - 1)), range(1, least(terminal - 1, n.n - 1) + 1)) AS pos
  FROM n WHERE n.n >= 3 AND least(terminal - 1, n.n - 1) > 1),
calls AS (SELECT t, step_index, raw_text, tool_name, {_family_sql("lower(tool_name)")} AS family FROM s WHERE step_role = 'tool_call' AND tool_name <> ''),
call AS (SELECT *, ({_OTHERS})[1 + {_draw("family", f"len({_OTHERS})")}] AS other FROM calls WHERE family IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY md5(concat_ws(':', '42', concat(t, ':'), 'call', CAST(step_index AS VARCHAR)))) = 1),
tool AS (SELECT *, ({_TOOLS})[1 + {_draw("tool", f"len({_TOOLS})")}] AS wrong FROM call),
made AS (
  SELECT t, 'wrong_plan' AS kind, 'structural' AS family, step_index AS pos, 'raw_text' AS slot, raw_text AS before, plan AS after, 'template_inferior_plan' AS method, {_arrival("wrong_plan")} AS arrival FROM plan WHERE plan IS NOT NULL
  UNION ALL SELECT t, 'false_terminal', 'terminal_flag', pos[1 + {_draw("end", "len(pos)")}], 'is_terminal_step', 'false', 'true', 'false_terminal_flag', {_arrival("false_terminal")} FROM ends
  UNION ALL SELECT t, 'premature_termination', 'terminal_flag', c, 'trajectory_length', CAST(n AS VARCHAR), CAST((SELECT count(*) FROM s WHERE s.t = x.t AND s.step_index <= c) AS VARCHAR), 'premature_truncation', {_arrival("premature_termination")}
    FROM (SELECT *, pos[1 + {_draw("cut", "len(pos)")}] AS c FROM cuts) x
  UNION ALL SELECT t, 'wrong_tool_family', 'tool_selection', step_index, 'tool_name', tool_name, wrong, 'cross_family_tool_swap', {_arrival("wrong_tool_family")} FROM tool),
record AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY t ORDER BY arrival, kind) = 1)"""


@query(
    "coarse_records",
    rf"""WITH {RECORDS_SQL},
    changed AS (
      SELECT s.* REPLACE (
        CASE WHEN r.kind = 'wrong_plan' AND s.step_index = r.pos THEN r.after WHEN r.kind = 'wrong_tool_family' AND s.step_index = r.pos THEN replace(raw_text, r.before, r.after) ELSE raw_text END AS raw_text,
        CASE WHEN r.kind = 'wrong_tool_family' AND s.step_index = r.pos THEN r.after ELSE tool_name END AS tool_name,
        is_terminal_step OR (r.kind IN ('false_terminal', 'premature_termination') AND s.step_index = r.pos) AS is_terminal_step,
        produces_final_answer OR (r.kind IN ('false_terminal', 'premature_termination') AND s.step_index = r.pos) AS produces_final_answer)
      FROM s JOIN record r ON r.t = s.t WHERE r.kind <> 'premature_termination' OR s.step_index <= r.pos)
    SELECT r.t AS trajectory_id, 'coarse_grained' AS perturbation_class, r.family AS perturbation_family, r.kind AS perturbation_type, CAST(r.pos AS INT) AS target_step_index, r.slot AS target_slot,
      md5(r.before) AS original_value, md5(r.after) AS perturbed_value, r.method AS mutation_method,
      concat('pert_', r.t, '_', substr(md5(concat_ws('|', r.t, r.kind, CAST(r.pos AS VARCHAR), r.slot, coalesce(r.after, ''))), 1, 8)) AS perturbation_id,
      (SELECT md5(string_agg({_SHOWN.format('c.')}, chr(10) ORDER BY c.step_index)) FROM changed c WHERE c.t = r.t) AS steps
    FROM record r""",
)
def coarse_records(spark, d):
    made = structural.coarse(trajectories(spark, d))
    return made.select(
        "trajectory_id", "perturbation_class", "perturbation_family", "perturbation_type", "target_step_index", "target_slot", F.md5("original_value").alias("original_value"),
        F.md5("perturbed_value").alias("perturbed_value"), "mutation_method", "perturbation_id", shown("perturbed_steps").alias("steps"),
    )


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four kinds by conversation: coarse ones, a value inside a call's arguments, a step that went, a step that came."""
    own = trajectories(spark, sf_dir)
    made = structural.coarse(own.filter("conv_id % 4 = 0"))
    record = lambda df, cls, kind, at, slot, before, after, steps: df.select(
        *own.columns, F.lit(cls).alias("perturbation_class"), F.lit("structural" if slot == "step" else "parameter").alias("perturbation_family"), F.lit(kind).alias("perturbation_type"), at.alias("target_step_index"),
        F.lit(slot).alias("target_slot"), before.alias("original_value"), after.alias("perturbed_value"), F.lit("fixture").alias("mutation_method"), F.lit(None).cast(structural.UNDO).alias("undo"), steps.alias("perturbed_steps"),
    )
    from ..functions.json_text import value_at

    steps, none = F.col("steps"), F.lit(None).cast("string")
    called = own.filter("conv_id % 4 = 1").withColumn("_call", F.get(F.filter(steps, lambda s: s["tool_arguments"].isNotNull()), 0)).filter("_call is not null")
    slot = "tool_arguments.opts.path"
    before = value_at(F.col("_call.tool_arguments"), F.array(F.lit("opts"), F.lit("path")))
    after = F.lit('"/tmp/wrong.py"')
    inside = record(called, "fine_grained", "wrong_parameter", F.col("_call.step_index"), slot, before, after, structural.with_slot(steps, F.col("_call.step_index"), F.lit(slot), after))
    middle = (F.size(steps) / 2).cast("int")
    gone = record(own.filter("conv_id % 4 = 2"), "coarse_grained", "skipped", middle, "step", F.to_json(F.get(steps, middle), {"ignoreNullFields": "true"}), none, structural.without_step(steps, middle))
    extra = F.get(steps, F.lit(0)).withField("step_index", middle).withField("raw_text", F.lit("Inserted."))
    came = record(own.filter("conv_id % 4 = 3"), "coarse_grained", "inserted", middle + 1000, "step", none, F.to_json(extra), F.concat(F.slice(steps, F.lit(1), middle), F.array(extra.withField("step_index", middle + 1000)), F.slice(steps, middle + 1, F.size(steps))))
    out = made.drop("perturbation_id").unionByName(inside).unionByName(gone).unionByName(came).withColumn("perturbation_id", structural.perturbation_id())
    return out.withColumns({"source_trajectory_id": F.concat("benchmark", F.lit("_"), "trajectory_id"), "perturbation_index": F.col("conv_id") % 1000})


@query(
    "assembled_units",
    rf"""WITH {RECORDS_SQL},
    called AS (SELECT t, conv_id, min(step_index) AS pos FROM s WHERE conv_id % 4 = 1 AND tool_arguments IS NOT NULL GROUP BY ALL),
    r AS (
      SELECT t, pos, (SELECT min(conv_id) FROM s WHERE s.t = record.t) AS conv_id, CASE WHEN kind = 'premature_termination' THEN CAST(after AS BIGINT) END AS left_, kind FROM record
      UNION ALL SELECT t, pos, conv_id, NULL, 'wrong_parameter' FROM called
      UNION ALL SELECT n.t, n.n // 2, (SELECT min(conv_id) FROM s WHERE s.t = n.t), n.n - 1, 'skipped' FROM n
      UNION ALL SELECT n.t, n.n // 2 + 1000, (SELECT min(conv_id) FROM s WHERE s.t = n.t), n.n + 1, 'inserted' FROM n),
    mine AS (SELECT * FROM r WHERE conv_id % 4 = CASE kind WHEN 'wrong_parameter' THEN 1 WHEN 'skipped' THEN 2 WHEN 'inserted' THEN 3 ELSE 0 END),
    named AS (SELECT mine.*, concat(CASE conv_id % 3 WHEN 0 THEN 'swebench' WHEN 1 THEN 'gaia' ELSE 'toolbench' END, '_', mine.t) AS source FROM mine),
    unit AS (SELECT *, printf('eval::%s::%03d', source, conv_id % 1000) AS unit_id FROM named)
    SELECT unit_id AS evaluation_unit_id, concat(source, '::base') AS baseline_variant_id, printf('%s::pert::%03d', source, conv_id % 1000) AS perturbed_variant_id, kind AS perturbation_type,
      (SELECT md5(string_agg({_SHOWN.format('s.')}, chr(10) ORDER BY s.step_index)) FROM s WHERE s.t = unit.t) AS baseline,
      CAST(n.n AS INT) AS baseline_num_steps, CAST(coalesce(left_, n.n) AS INT) AS perturbed_num_steps, printf('%s::step::%d', source, unit.pos) AS target_step_canonical_id,
      (SELECT string_agg(printf('%s::step::%d/%d', source, s.step_index, s.step_index), ',' ORDER BY s.step_index) FROM s WHERE s.t = unit.t) AS baseline_steps,
      CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END AS replay_tier,
      ('0x' || substr(sha256(concat(unit_id, ':42')), 8, 1))::INT % 2 = 0 AS is_a_baseline, CAST(NULL AS VARCHAR) AS error
    FROM unit JOIN n ON n.t = unit.t""",
)
def assembled_units(spark, d):
    made = units.assembled(patched(spark, d))
    return made.select(
        "evaluation_unit_id", "baseline_variant_id", "perturbed_variant_id", "perturbation_type", F.expr(f"md5(array_join(transform(baseline, b -> {_SHOWN.format('b.step.')}), '\\n'))").alias("baseline"),
        "derived_cache.baseline_num_steps", "derived_cache.perturbed_num_steps", "derived_cache.target_step_canonical_id",
        F.array_join(F.transform("baseline", lambda b: F.format_string("%s/%d", b["canonical_step_id"], b["display_step_index"])), ",").alias("baseline_steps"), "replay_tier", "blinding.is_a_baseline", "error",
    )


#: A record of each turn, many with faults, and its trajectory's steps, some with faults.
RECORD = {
    "perturbation_id": "CASE WHEN turn = 5 THEN NULL ELSE concat('p', conv_id, '_', turn) END",
    "original_trajectory_id": "concat('t', conv_id)",
    "generation_timestamp": "'2024-01-01'",
    "perturbation_class": "CASE turn % 4 WHEN 0 THEN 'placebo' WHEN 1 THEN 'fine_grained' WHEN 2 THEN 'coarse_grained' ELSE CASE WHEN length(text) % 2 = 0 THEN 'fine_grained' ELSE 'other' END END",
    "perturbation_family": "CASE length(text) % 5 WHEN 0 THEN 'data_reference' WHEN 1 THEN 'parameter' WHEN 2 THEN 'structural' WHEN 3 THEN 'tool_selection' ELSE 'terminal_flag' END",
    "perturbation_type": "CASE length(text) % 7 WHEN 0 THEN 'wrong_value' WHEN 1 THEN 'query_drift' WHEN 2 THEN 'wrong_plan' WHEN 3 THEN 'near_neighbor_tool' WHEN 4 THEN 'wrong_tool_family' WHEN 5 THEN 'synonym' ELSE 'strange' END",
    "target_step_index": "CAST(turn - CASE WHEN length(text) % 13 = 0 THEN 9 ELSE 0 END AS INT)",
    "target_slot": "CASE WHEN length(text) % 11 = 0 THEN ' ' ELSE 'raw_text' END",
    "mutation_method": "'m'",
    "original_value": "text",
    "perturbed_value": "CASE length(text) % 4 WHEN 0 THEN replace(text, 'e', 'E') WHEN 1 THEN concat(text, ' read 7') WHEN 2 THEN concat(text, ' ', 'in /a/b.txt') ELSE concat(' ', text) END",
    "critical_path_score": "CAST(length(text) % 10 AS DOUBLE) / 10",
    "affects_final_answer": "length(text) % 3 = 0",
    "recoverable_if_wrong": "length(text) % 2 = 0",
}
_FAULTY = {
    "step_index": "CAST(turn + CASE WHEN turn >= 3 AND conv_id % 5 = 0 THEN 1 ELSE 0 END AS INT)",
    "step_role": "CASE WHEN length(text) % 19 = 0 THEN NULL WHEN role = 'user' THEN 'reasoning' ELSE 'tool_call' END",
    "raw_text": "CASE WHEN length(text) % 17 = 0 THEN ' ' ELSE text END",
    "tool_name": "CASE WHEN length(text) % 6 > 0 THEN 'bash' END",
}
_MARKS = lambda c, p: f"list_sort(list_distinct(regexp_extract_all({c}, '{p}')))"
_SAME = lambda p, low=False: " = ".join(_MARKS(f"lower({c})" if low else c, p) for c in ("original_value", "perturbed_value"))
_KNOWN = f"(perturbation_class IN {record_checks.FAMILIES and tuple(record_checks.FAMILIES)} AND perturbation_type IN {record_checks.ALL_TYPES})"
_PLACEBO = f"(perturbation_class = 'placebo' OR perturbation_type IN {record_checks.PLACEBO_TYPES})"
_OF_CLASS = " OR ".join(f"(perturbation_class = '{c}' AND perturbation_family IN {f})" for c, f in record_checks.FAMILIES.items())
_OF_FAMILY = " OR ".join(f"(perturbation_family = '{f}' AND perturbation_type IN {t})" for f, t in record_checks.TYPES.items())
CHECKS_SQL = rf"""WITH r AS (SELECT conv_id, turn, {", ".join(f"{e} AS {c}" for c, e in RECORD.items())} FROM conversations),
f AS (SELECT conv_id, {", ".join(f"{e} AS {c}" for c, e in _FAULTY.items())} FROM conversations),
c AS (SELECT conv_id, bool_and(step_index IS NOT NULL AND step_role IS NOT NULL AND raw_text IS NOT NULL) AS fields, max(step_index) = count(*) - 1 AS sequential,
  bool_and(coalesce(step_role, '') <> 'tool_call' OR coalesce(tool_name, '') <> '') AS tools, bool_and(NOT regexp_matches(raw_text, '^\s*$')) AS texts FROM f GROUP BY 1),
x AS (SELECT r.*, c.*, {_PLACEBO} AS placebo, {_KNOWN} AS known FROM r JOIN c ON c.conv_id = r.conv_id),
k AS (
  SELECT *, unnest([
    {{'name': 'schema_required_fields', 'passed': perturbation_id IS NOT NULL AND trim(target_slot) <> '', 'severity': 'error', 'applies': true}},
    {{'name': 'schema_perturbation_class', 'passed': perturbation_class <> 'other', 'severity': 'error', 'applies': true}},
    {{'name': 'schema_perturbation_family', 'passed': true, 'severity': 'error', 'applies': true}},
    {{'name': 'schema_perturbation_type', 'passed': perturbation_type <> 'strange', 'severity': 'error', 'applies': true}},
    {{'name': 'schema_target_step_index', 'passed': target_step_index >= 0, 'severity': 'error', 'applies': true}},
    {{'name': 'diff_placebo_numbers', 'passed': {_SAME(r"\b\d+(?:\.\d+)?\b")}, 'severity': 'warning', 'applies': placebo}},
    {{'name': 'diff_placebo_tools', 'passed': {_SAME(r"\b(?:read|write|search|grep|find|cat|ls|git|bash|execute|submit)\b", True)}, 'severity': 'warning', 'applies': placebo}},
    {{'name': 'diff_placebo_filepaths', 'passed': {_SAME(r"(?:/[\w.-]+)+(?:\.\w+)?")}, 'severity': 'warning', 'applies': placebo}},
    {{'name': 'diff_content_changed', 'passed': lower(trim(original_value, E' \t\n')) <> lower(trim(perturbed_value, E' \t\n')), 'severity': 'error', 'applies': NOT placebo}},
    {{'name': 'coherence_has_steps', 'passed': true, 'severity': 'error', 'applies': true}},
    {{'name': 'coherence_step_fields', 'passed': fields, 'severity': 'error', 'applies': true}},
    {{'name': 'coherence_sequential_indices', 'passed': sequential, 'severity': 'warning', 'applies': true}},
    {{'name': 'coherence_tool_names', 'passed': tools, 'severity': 'warning', 'applies': true}},
    {{'name': 'coherence_no_empty', 'passed': texts, 'severity': 'warning', 'applies': true}},
    {{'name': 'class_family_enum_parse', 'passed': false, 'severity': 'error', 'applies': NOT known}},
    {{'name': 'class_family_combination', 'passed': {_OF_CLASS}, 'severity': 'error', 'applies': known}},
    {{'name': 'family_type_combination', 'passed': {_OF_FAMILY}, 'severity': 'error', 'applies': known}},
    {{'name': 'tool_selection_class_rule', 'passed': perturbation_class = CASE perturbation_type WHEN 'near_neighbor_tool' THEN 'fine_grained' ELSE 'coarse_grained' END, 'severity': 'error',
      'applies': known AND perturbation_family = 'tool_selection' AND perturbation_type IN ('near_neighbor_tool', 'wrong_tool_family')}}]) AS k
  FROM x)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    steps = turns.selectExpr("conv_id", *[f"{e} AS {c}" for c, e in _FAULTY.items()]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*_FAULTY))).alias("perturbed_steps"))
    return turns.selectExpr("conv_id", "turn", *[f"{e} AS {c}" for c, e in RECORD.items()]).join(steps, "conv_id")


@query("record_check_rows", CHECKS_SQL + " SELECT conv_id, turn, k.name AS name, k.passed AS passed, k.severity AS severity FROM k WHERE k.applies")
def record_check_rows(spark, d):
    return record_checks.check_rows(faulty(spark, d), "conv_id", "turn")


@query(
    "record_status",
    CHECKS_SQL
    + """, e AS (SELECT * FROM k WHERE k.applies AND NOT k.passed AND k.severity = 'error'),
    i AS (SELECT conv_id, turn, CASE WHEN placebo THEN 0 ELSE
        CASE WHEN perturbation_class = 'coarse_grained' THEN greatest(2, v) ELSE v END END AS impact
      FROM (SELECT *, greatest(0, least(3, CASE WHEN critical_path_score < 0.25 THEN 0 WHEN critical_path_score < 0.5 THEN 1 WHEN critical_path_score < 0.75 THEN 2 ELSE 3 END + CAST(affects_final_answer AS INT)) - CAST(recoverable_if_wrong AS INT)) AS v FROM x))
    SELECT x.conv_id, x.turn, CASE
        WHEN EXISTS (SELECT 1 FROM e WHERE e.conv_id = x.conv_id AND e.turn = x.turn AND (starts_with(e.k.name, 'schema_') OR e.k.name = 'diff_content_changed')) THEN 'invalid'
        WHEN EXISTS (SELECT 1 FROM e WHERE e.conv_id = x.conv_id AND e.turn = x.turn AND (starts_with(e.k.name, 'coherence_') OR starts_with(e.k.name, 'class_family') OR starts_with(e.k.name, 'tool_selection'))) THEN 'borderline'
        ELSE 'valid' END AS generation_status,
      (SELECT count(*) FROM k WHERE k.conv_id = x.conv_id AND k.turn = x.turn AND k.k.applies AND NOT k.k.passed AND k.k.severity = 'warning') AS warnings, CAST(i.impact AS INT) AS expected_impact
    FROM x JOIN i ON i.conv_id = x.conv_id AND i.turn = x.turn""",
)
def record_status(spark, d):
    return record_checks.checked(faulty(spark, d)).select("conv_id", "turn", "generation_status", F.size("warnings").cast("long").alias("warnings"), F.col("expected_impact").cast("int").alias("expected_impact"))


@query(
    "record_changes",
    rf"""WITH {RECORDS_SQL} SELECT r.t AS trajectory_id, r.kind AS perturbation_type, CASE WHEN r.kind = 'premature_termination' THEN n.n - CAST(r.after AS BIGINT) ELSE 0 END AS removed,
      CASE r.kind WHEN 'wrong_plan' THEN 'raw_text' WHEN 'wrong_tool_family' THEN CASE WHEN contains(s.raw_text, s.tool_name) THEN 'raw_text,tool_name' ELSE 'tool_name' END
        ELSE CASE WHEN s.produces_final_answer THEN 'is_terminal_step' ELSE 'is_terminal_step,produces_final_answer' END END AS fields
    FROM record r JOIN n ON n.t = r.t JOIN s ON s.t = r.t AND s.step_index = r.pos""",
)
def record_changes(spark, d):
    """What differs between a trajectory and its perturbed form: the target alone, and what a truncation removes."""
    made = structural.coarse(trajectories(spark, d)).withColumn("changes", record_checks.step_changes(F.col("steps"), F.col("perturbed_steps")))
    of = lambda kind: F.filter("changes", lambda c: c["kind"] == kind)
    fields = F.flatten(F.transform(of("changed"), lambda c: F.when(c["step_index"] == F.col("target_step_index"), c["fields"]).otherwise(F.array(F.lit("elsewhere")))))
    return made.select("trajectory_id", "perturbation_type", F.size(of("removed")).cast("long").alias("removed"), F.array_join(fields, ",").alias("fields"))


_CATALOGUE = "SELECT DISTINCT concat('tool_', p_partkey) AS tool, p_brand AS family FROM part"
_PLACED = f"""c AS ({_CATALOGUE}),
p AS (SELECT tool, family, row_number() OVER (ORDER BY family, ('0x' || substr(md5(tool), 1, 2))::INT % 64, md5(tool), tool) - 1 AS place, count(*) OVER (PARTITION BY family) AS size, count(*) OVER () AS total FROM c),
q AS (SELECT *, min(place) OVER (PARTITION BY family) AS first FROM p),
asked AS (SELECT concat(l_orderkey, '-', l_linenumber) AS key, concat('tool_', l_partkey) AS tool FROM lineitem)"""


def _asked(spark, d):
    catalogue = table(spark, d, "part").selectExpr("concat('tool_', p_partkey) AS tool", "p_brand AS family")
    return table(spark, d, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS key", "concat('tool_', l_partkey) AS tool"), catalogue


def _substitute_sql(salt: str, among: str, place: str) -> str:
    r = f"('0x' || substr(md5(concat_ws(':', '7', key, '{salt}')), 1, 8))::BIGINT % greatest({among}, 1)"
    d = f"SELECT *, CASE WHEN {among} > 0 THEN {place} END AS at FROM (SELECT *, {r} AS r FROM asked LEFT JOIN q USING (tool))"
    return f"WITH {_PLACED} SELECT key, d.tool, o.tool AS substitute FROM ({d}) d LEFT JOIN p o ON o.place = d.at"


@query("tools_of_other_families", _substitute_sql("anti", "total - size", "CASE WHEN r < first THEN r ELSE r + size END"))
def tools_of_other_families(spark, d):
    return structural.substituted(*_asked(spark, d), 7, near=False)


@query("tools_of_same_family", _substitute_sql("near", "size - 1", "first + (place - first + 1 + r) % size"))
def tools_of_same_family(spark, d):
    return structural.substituted(*_asked(spark, d), 7, near=True)


#: Slots of the fixture's calls in the order in which they're written: (which arguments, slot, value type).
_SLOTS = (
    (0, 1, "query", "search_query"), (0, 2, "top_k", "integer"), (0, 3, "opts.deep", "boolean"), (0, 4, "opts.path", "filepath"), (1, 1, "top_k", "integer"), (1, 2, "opts.path", "filepath"), (1, 3, "opts.deep", "boolean"),
    (2, 1, "opts.path", "filepath"), (2, 2, "query", "search_query"), (3, 1, "opts.deep", "boolean"), (3, 2, "opts.path", "filepath"), (3, 3, "top_k", "integer"), (4, 1, "name", "entity_name"), (4, 2, "opts.path", "filepath"),
)


def slots(trajectories: DataFrame) -> DataFrame:
    """The slots that typing finds in the steps."""
    flat = trajectories.select("trajectory_id", F.inline("steps")).withColumns({c: F.lit(None).cast("string") for c in ("extracted_value", "value_type")})
    return typing.step_slots(flat.withColumn("produces_final_answer", F.lit(False)), ["trajectory_id", "step_index"])


@query(
    "perturbation_choices",
    f"""WITH RECURSIVE {STEPS_SQL},
    s AS (SELECT *, trajectory_id AS t, length(raw_text) % 5 AS shape, 0.3 + critical_path_score AS base FROM step),
    kinds AS (SELECT * FROM (VALUES {", ".join(f"({a}, {o}, 'tool_arguments.{n}')" for a, o, n, _ in _SLOTS)}) k(shape, o, slot)),
    c AS (
      SELECT t, step_index, 'tool_name' AS slot, base + 0.2 AS score, ['fine_grained', 'coarse_grained'] AS classes, 0 AS part, 0 AS o FROM s WHERE tool_name IS NOT NULL
      UNION ALL SELECT t, step_index, k.slot, base + 0.4, ['fine_grained', 'placebo'], 0, k.o FROM s JOIN kinds k ON k.shape = s.shape WHERE tool_arguments IS NOT NULL
      UNION ALL SELECT t, step_index, 'terminal_flags', base + 0.2, ['coarse_grained'], 1, 0 FROM s WHERE NOT is_terminal_step AND {_RESULT}
      UNION ALL SELECT t, step_index, 'step_structure', base + 0.2, ['coarse_grained'], 2, 0 FROM s WHERE critical_path_score >= 0.6 AND step_index > 0
      UNION ALL SELECT t, step_index, 'tool_name', base + 0.2, ['coarse_grained'], 3, 0 FROM s WHERE tool_name IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(score, 6) DESC, part, step_index, o) AS k FROM c),
    walk(t, k, fine, placebo, coarse, used, slot, step_index, class) AS (
      SELECT DISTINCT t, 0::BIGINT, 0, 0, 0, []::INT[], NULL::VARCHAR, NULL::INT, NULL::VARCHAR FROM c
      UNION ALL
      SELECT t, k, fine + CAST(w IS NOT DISTINCT FROM 'fine_grained' AS INT), placebo + CAST(w IS NOT DISTINCT FROM 'placebo' AS INT), coarse + CAST(w IS NOT DISTINCT FROM 'coarse_grained' AS INT),
        CASE WHEN w IS NULL THEN used ELSE list_append(used, step_index) END, slot, step_index, w
      FROM (SELECT w.t, k.k, fine, placebo, coarse, used, k.slot, k.step_index,
          CASE WHEN fine + placebo + coarse >= 5 THEN NULL
            WHEN list_contains(classes, 'fine_grained') AND fine < 3 THEN CASE WHEN list_contains(used, k.step_index) AND fine < 2 THEN NULL ELSE 'fine_grained' END
            WHEN list_contains(classes, 'placebo') AND placebo < 1 THEN 'placebo'
            WHEN list_contains(classes, 'coarse_grained') AND coarse < 1 THEN 'coarse_grained' END AS w
        FROM walk w JOIN k ON k.t = w.t AND k.k = w.k + 1))
    SELECT t AS trajectory_id, CAST(row_number() OVER (PARTITION BY t ORDER BY k) - 1 AS INT) AS place, step_index, slot, class AS perturbation_class FROM walk WHERE class IS NOT NULL""",
)
def perturbation_choices(spark, d):
    own = trajectories(spark, d)
    return generation.choices(generation.with_candidates(own, slots(own)), 5).select("trajectory_id", "place", "step_index", "slot", "perturbation_class")


@query("generated_records")
def generated_records(spark, d):
    """Records of all classes; the baseline that undoing them gives is the trajectory's own."""
    own = trajectories(spark, d)
    made = generation.generated(own, slots(own), 5)
    back = units.reverted(*[F.col(c) for c in ("perturbed_steps", "target_step_index", "target_slot", "original_value", "perturbed_value", "undo")])
    shape = ("perturbation_id", "trajectory_id", "place", "perturbation_class", "perturbation_family", "perturbation_type", "target_step_index", "target_slot", "original_value", "perturbed_value", "mutation_method")
    return made.withColumn("_back", back).select(*shape, shown("steps").alias("steps"), shown("perturbed_steps").alias("perturbed"), shown("_back").alias("baseline"))


_WORDS = {w: o for a, b in perturbation.SYNONYMS for w, o in ((a, b), (b, a))}
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _WORDS.items()) + "}"
_PIECES = "|".join([*sorted(perturbation.PROTECTED, key=len, reverse=True), r"[\p{L}\p{N}_]+", r"(?s:[^\p{L}\p{N}_])"])
_NEW = f"{_MAP}[lower(x)]"


@query(
    "synonym_texts",
    rf"""WITH d AS (SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, concat('Find the ', text, ' USING Action: Finish check') FROM conversations),
    m AS (SELECT doc_id, t, array_to_string(list_transform(regexp_extract_all(t, '{_PIECES}'), lambda x: CASE WHEN x IN {perturbation.PROTECTED} OR {_NEW} IS NULL THEN x WHEN x = upper(x) AND x <> lower(x) THEN upper({_NEW})
      WHEN x[1] = upper(x[1]) AND x[1] <> lower(x[1]) THEN concat(upper({_NEW}[1]), lower({_NEW}[2:])) ELSE {_NEW} END), '') AS m FROM d)
    SELECT doc_id, md5(CASE WHEN m <> t THEN m END) AS made FROM m""",
)
def synonym_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    said = table(spark, d, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), F.concat(F.lit("Find the "), "text", F.lit(" USING Action: Finish check")).alias("text"))
    return docs.unionByName(said).select("doc_id", F.md5(perturbation.with_synonyms(F.col("text"))).alias("made"))


def _h(salt: str, n: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '3', CAST(k AS VARCHAR), '{salt}')), 1, 8))::BIGINT % ({n}))"


_USUAL = "list_filter([0, 1, -1, 100, 1000, n * 2, CAST(floor(n / 2.0) AS BIGINT)], lambda x: x <> n)"


@query(
    "parameter_mutations",
    f"""WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4001 - 700 END AS n FROM orders),
    r AS (SELECT k, n, CASE WHEN {_h("fifth", "2")} = 1 THEN 1 ELSE -1 END * greatest(2, abs(n) // 5) AS fifth, CASE WHEN {_h("obo", "2")} = 1 THEN 1 ELSE -1 END AS obo, {_h("shift", "2")} = 0 AS more FROM v)
    SELECT k, CAST(n + fifth AS VARCHAR) AS wrong, concat('wrong_value_offset_', fifth) AS wrong_method, CAST(greatest(0, n + obo) AS VARCHAR) AS off, concat('off_by_one_', CASE WHEN obo > 0 THEN '+1' ELSE '-1' END) AS off_method,
      CASE WHEN n = 0 THEN '10' WHEN more THEN CAST(n * 10 AS VARCHAR) ELSE CAST(CAST(trunc(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS shifted,
      CASE WHEN n = 0 THEN 'threshold_shift_from_zero' WHEN more THEN 'threshold_shift_scale_10x' ELSE 'threshold_shift_scale_0.1x' END AS shift_method,
      CAST(({_USUAL})[1 + {_h("usual", f"len({_USUAL})")}] AS VARCHAR) AS usual FROM r""",
)
def parameter_mutations(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4001 - 700 END AS STRING) AS v")
    of = lambda f: f(F.lit("integer"), F.col("v"), 3, F.col("k"))
    made = rows.select("k", of(perturbation.wrong_value).alias("w"), of(perturbation.off_by).alias("o"), of(perturbation.threshold_shift).alias("t"), of(perturbation.wrong_parameter).alias("u"))
    return made.select("k", F.col("w.value").alias("wrong"), F.col("w.method").alias("wrong_method"), F.col("o.value").alias("off"), F.col("o.method").alias("off_method"), F.col("t.value").alias("shifted"), F.col("t.method").alias("shift_method"), F.col("u.value").alias("usual"))
