"""Queries of quality gates, curation rules, graders, identifiers and further scoring rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import curation, gates, perturbation, relational, sampling, typing
from ..sources import parsers, table
from .base import FACTS_SQL, facts, r, rounded
from .records import trajectories

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            S[name] = sql
        return f

    return add


def _gate(name: str, source: str, bad: str, key: str, value: str, threshold: float, ok: str, checked: str = "true", warn: str = "fail") -> str:
    return f"""SELECT '{name}' AS gate, CASE WHEN checked = 0 THEN 'skip' WHEN {ok} THEN 'pass' ELSE '{warn}' END AS status, {r('v')} AS value, CAST({threshold} AS DOUBLE) AS threshold, checked, violations, examples FROM
    (SELECT count(*) FILTER (WHERE {checked}) AS checked, count(*) FILTER (WHERE {bad}) AS violations, CAST({value} AS DOUBLE) AS v,
     coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT CAST({key} AS VARCHAR) AS i FROM {source} WHERE {bad} ORDER BY i LIMIT 5)), '') AS examples FROM {source})"""


#: Texts before and after a change, the same text in both engines.
_BEFORE = "concat('Take ', sample, ' of /a/b', order_id, '.txt')"
_AFTER = "CASE WHEN order_id % 7 = 0 THEN concat('Take ', sample, ' of /a/b', order_id, '.txt') WHEN order_id % 11 = 0 THEN concat('Take ', sample + 1, ' of /a/b', order_id, '.txt') WHEN order_id % 13 = 0 THEN concat('Take ', sample, ' of /a/c.txt') ELSE concat('Use ', sample, ' of /a/b', order_id, '.txt') END"
_KEEPS = "order_id % 7 = 0 OR (order_id % 11 > 0 AND order_id % 13 > 0)"
_ACTED = "CASE event_id % 5 WHEN 0 THEN concat('Action: a', chr(10), 'Action: b ', event_id) WHEN 1 THEN 'Step 1, Step 2, Step 3' WHEN 2 THEN '{\"a\": {\"b\": 1}} and {' ELSE event_type END"
_PROMPT = "CASE event_id % 6 WHEN 0 THEN 'Which one has an error?' WHEN 1 THEN 'The baseline is planning tool_selection parameter data_reference other' WHEN 2 THEN concat('planning tool_selection parameter data_reference other ```json {\"a\": ', chr(123), chr(123), 'x', chr(125), chr(125), '} ```') WHEN 3 THEN 'planning tool_selection parameter data_reference other ```json {\"a\": } ```' WHEN 4 THEN 'planning tool_selection parameter data_reference other trajectory_a is good' ELSE 'planning tool_selection parameter data_reference other' END"
_MORE = f"""acted AS (SELECT event_id, {_ACTED} AS t FROM events), moved AS (SELECT *, {_BEFORE} AS b, {_AFTER} AS a FROM facts), asked AS (SELECT event_id, {_PROMPT} AS p, event_id % 6 AS k FROM events),
placed AS (SELECT *, substr(md5(concat(order_id, ':x')), 1, 1) < '8' AS side FROM facts), again AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"""
_KNOWN = "perturbation_class IN ('placebo', 'fine_grained', 'coarse_grained')"
_SHARES = {"placebo": 0.2, "fine_grained": 0.5, "coarse_grained": 0.3}
_FAR = "greatest(" + ", ".join(f"abs(CAST(count(*) FILTER (WHERE perturbation_class = '{c}') AS DOUBLE) / count(*) - {t})" for c, t in _SHARES.items()) + ")"


@query(
    "gate_report_more",
    f"WITH {FACTS_SQL}, {_MORE} "
    + " UNION ALL ".join(
        [
            _gate("no_structural_corruption", "acted", "event_id % 5 < 3", "event_id", "avg(CAST(event_id % 5 < 3 AS INT))", 0, "v <= 0"),
            _gate("class_distribution", "facts", f"NOT {_KNOWN}", "unit_id", _FAR, 0.05, "v <= 0.05", _KNOWN),
            _gate("perturbation_class_validity", "facts", "class_matches = 0", "unit_id", "avg(CASE WHEN class_matches = 1 THEN 1.0 WHEN class_matches = 0 THEN 0.0 END)", 0.9, "v >= 0.9", "class_matches IS NOT NULL"),
            _gate("blinding_balance", "placed", "false", "unit_id", "avg(CAST(side AS INT))", 0.45, "v BETWEEN 0.45 AND 0.55"),
            _gate("length_preservation", "facts", "perturbation_type <> 'wrong_plan' AND sample <> expected_impact", "unit_id", "count(*) FILTER (WHERE perturbation_type <> 'wrong_plan' AND sample <> expected_impact)", 0, "v = 0", "perturbation_type <> 'wrong_plan'"),
            _gate("unique_ids", "again", "n > 1", "user_id", "sum(n - 1)", 0, "v = 0"),
            _gate("placebo_preserves_semantics", "moved", f"perturbation_class = 'placebo' AND NOT ({_KEEPS})", "unit_id", f"count(*) FILTER (WHERE perturbation_class = 'placebo' AND NOT ({_KEEPS}))", 0, "v = 0", "perturbation_class = 'placebo'", "warn"),
            _gate("non_placebo_meaningful", "moved", "perturbation_class <> 'placebo' AND a = b", "unit_id", "count(*) FILTER (WHERE perturbation_class <> 'placebo' AND a = b)", 0, "v = 0", "perturbation_class <> 'placebo'"),
            _gate("output_parsability", "events", "NOT json_valid(props)", "event_id", "avg(CAST(json_valid(props) AS INT))", 0.95, "v >= 0.95"),
            *[_gate(name, "asked", bad, "event_id", f"count(*) FILTER (WHERE {bad})", 0, "v = 0") for name, bad in (("no_priming", "k = 0"), ("no_blinding_leak", "k = 1"), ("vocabulary", "k = 0"), ("json_examples", "k = 3"), ("neutrality", "k = 4"))],
        ]
    ),
)
def gate_report_more(spark, d):
    rows, events = facts(spark, d), table(spark, d, "events")
    moved = rows.withColumns({"b": F.expr(_BEFORE), "a": F.expr(_AFTER)})
    parts = [
        gates.no_structural_corruption(events.select("event_id", F.expr(_ACTED).alias("t")), "event_id", "t", all_patterns=True),
        gates.class_distribution(rows, "unit_id", "perturbation_class", _SHARES),
        gates.class_validity(rows, "unit_id", "class_matches"),
        gates.blinding_balance(rows.withColumn("side", F.substring(F.md5(F.concat_ws(":", F.col("order_id").cast("string"), F.lit("x"))), 1, 1) < "8"), "unit_id", "side"),
        gates.length_preservation(rows, "unit_id", "sample", "expected_impact", "perturbation_type", exempt=("wrong_plan",)),
        gates.unique_ids(events, "user_id"),
        gates.placebo_semantics(moved, "unit_id", "b", "a", "perturbation_class"),
        gates.meaningful_change(moved, "unit_id", "b", "a", "perturbation_class"),
        gates.output_parsability(events, "event_id", "props"),
        gates.prompt_gates(events.select("event_id", F.expr(_PROMPT).alias("p")), "event_id", "p"),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("examples", F.array_join("examples", ","))


@query("corruption_names", f"WITH acted AS (SELECT event_id, {_ACTED} AS t FROM events) SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'duplicate_action' WHEN 1 THEN 'step_marker_repetition' WHEN 2 THEN 'nested_json_corruption' END AS corruption FROM acted")
def corruption_names(spark, d):
    return table(spark, d, "events").select("event_id", gates.corruption(F.expr(_ACTED)).alias("corruption"))


# -- curation ------------------------------------------------------------------
_TURNS = "t AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant' AND turn = 5) AS fin FROM conversations GROUP BY 1)"


@query("step_count_filter", f"WITH {_TURNS} SELECT conv_id AS trajectory_id, CASE WHEN n < 4 THEN concat('too_few_steps:', n, '<4') WHEN n > 6 THEN concat('too_many_steps:', n, '>6') END AS reject_reason FROM t")
def step_count_filter(spark, d):
    return curation.step_count_reason(trajectories(spark, d), 4, 6).select("trajectory_id", "reject_reason")


@query("rejection_counts", f"WITH {_TURNS} SELECT CASE WHEN n < 4 THEN 'too_few_steps' ELSE 'too_many_steps' END AS rule, count(*) AS n FROM t WHERE n < 4 OR n > 6 GROUP BY 1")
def rejection_counts(spark, d):
    return curation.rejection_counts(curation.step_count_reason(trajectories(spark, d), 4, 6))


_LOADED = f"""{_TURNS}, p AS (SELECT conv_id, coalesce(bool_or(p = 1 AND i <= greatest(2, n // 3)), false) AND coalesce(bool_or(p = 1 AND CASE WHEN n <= 3 THEN i = 2 ELSE i BETWEEN n // 3 + 1 AND 2 * (n // 3) END), false) AND coalesce(bool_or(p = 1 AND i >= greatest(n - 1, n - n // 3, 1)), false) AS covered FROM
  (SELECT conv_id, turn + 1 AS i, CASE WHEN role = 'assistant' AND turn % 3 = 0 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY 1),
x AS (SELECT conv_id, CASE WHEN n < 3 THEN concat('too_few_steps:', n) WHEN n > 8 THEN concat('too_many_steps:', n) WHEN conv_id % 11 <> 0 AND conv_id % 2 = 1 THEN 'task_success' WHEN NOT covered THEN 'parameter_coverage' END AS why FROM t JOIN p USING (conv_id))"""


@query("loader_rejections", f"WITH {_LOADED} SELECT conv_id AS trajectory_id, why AS reject_reason FROM x WHERE why IS NOT NULL")
def loader_rejections(spark, d):
    return curation.loaded(trajectories(spark, d), "toolbench", 20, low=3, high=8, success=True, coverage=True)[1]


@query("loader_sample", f"WITH {_LOADED} SELECT conv_id AS trajectory_id FROM x WHERE coalesce(why, '') IN ('', 'parameter_coverage') ORDER BY md5(concat('42:', conv_id)), conv_id LIMIT 20")
def loader_sample(spark, d):
    return curation.loaded(trajectories(spark, d), "toolbench", 20, low=3, high=8, success=True)[0].select("trajectory_id")


_CHECKED = """CASE conv_id % 4 WHEN 0 THEN '{"would_succeed": true, "error_detected": false, "score": 80}' WHEN 1 THEN '{"would_succeed": true, "error_detected": true, "score": 90}' WHEN 2 THEN 'unread' ELSE '{"would_succeed": true, "error_detected": false, "score": 10}' END"""


@query("verified_baselines", "SELECT DISTINCT conv_id AS trajectory_id FROM conversations WHERE conv_id % 4 = 0")
def verified_baselines(spark, d):
    said = table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("trajectory_id"), F.expr(_CHECKED).alias("response"))
    return curation.verified_baselines(trajectories(spark, d), said, 60).select("trajectory_id")


# -- sources -------------------------------------------------------------------
_SAID = "CASE event_id % 7 WHEN 0 THEN '<function=str_replace_editor><parameter=command>view</parameter></function>' WHEN 1 THEN '<function=str_replace_editor><parameter=command>create</parameter></function>' WHEN 2 THEN 'Now I Modify it' WHEN 3 THEN 'locate it' WHEN 4 THEN 'run pytest' WHEN 5 THEN 'cat file' ELSE 'thinking' END"


@query("swe_tool_names", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'view_file' WHEN 1 THEN 'str_replace_editor' WHEN 2 THEN 'file_edit' WHEN 3 THEN 'search_code' WHEN 4 THEN 'run_tests' WHEN 5 THEN 'view_file' END AS tool_name FROM events")
def swe_tool_names(spark, d):
    return table(spark, d, "events").select("event_id", parsers.swe_tool(F.expr(_SAID)).alias("tool_name"))


_STEPS = "concat('1. Search the web ', event_id, chr(10), '2. Click on it', chr(10), '3. Go to page', chr(10), '4. Think')"


@query(
    "gaia_steps",
    """WITH s AS (SELECT event_id, unnest([1, 2, 3, 4]) AS step_number, unnest([concat('Search the web ', event_id), 'Click on it', 'Go to page', 'Think']) AS content FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, step_number, content, CASE step_number WHEN 1 THEN 'web_search' WHEN 3 THEN 'web_browse' END AS tool_name, CASE WHEN step_number < 4 THEN 'tool_execution' ELSE 'reasoning' END AS step_type FROM s""",
)
def gaia_steps(spark, d):
    steps = F.struct(F.expr(_STEPS).alias("Steps"), F.lit(None).cast("string").alias("Tools"))
    return parsers.gaia_steps(table(spark, d, "events").select(F.col("event_id").cast("string").alias("task_id"), F.lit("q").alias("Question"), steps.alias("Annotator Metadata")))


_TURN = "concat('Thought: step ', turn, chr(10), 'Action: tool_', turn % 3, chr(10), 'Action Input: ', CASE WHEN turn % 2 = 0 THEN concat(chr(123), '\"k\": ', turn, chr(125)) ELSE 'free text' END)"


@query(
    "toolbench_steps",
    """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT CAST(conv_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS step_number, concat('step ', turn) AS content, concat('tool_', turn % 3) AS tool_name, CASE WHEN turn % 2 = 0 THEN concat('{"k": ', turn, '}') ELSE '{"raw_input":"free text"}' END AS tool_input,
      CASE WHEN nr = 'user' THEN nt END AS tool_output FROM t WHERE role = 'assistant'""",
)
def toolbench_steps(spark, d):
    turn = F.struct(F.when(F.col("role") == "user", "function").otherwise(F.col("role")).alias("from"), F.when(F.col("role") == "assistant", F.expr(_TURN)).otherwise(F.col("text")).alias("value"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("c")))).alias("c"))
    items = rows.select(F.col("conv_id").cast("string").alias("id"), F.transform("c", lambda x: x["c"]).alias("conversations"))
    return parsers.conversation_steps(items)


# -- graders, identifiers and scalar rules ---------------------------------------
_ANSWERED = "CASE event_id % 4 WHEN 0 THEN concat('  The answer is  ', user_id, ' ') WHEN 1 THEN concat('Answer: ', user_id) WHEN 2 THEN CAST(user_id AS STRING) ELSE 'unable to say, sorry' END"


@query("exact_grade", "SELECT event_id, event_id % 4 < 3 AS passed FROM events")
def exact_grade(spark, d):
    return table(spark, d, "events").select("event_id", text.exact_match(F.expr(_ANSWERED), F.col("user_id").cast("string")).alias("passed"))


@query(
    "grade_dispatch",
    f"""WITH g AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 4 < 3 THEN 1.0 ELSE 0.0 END WHEN 1 THEN 0.5 - CASE WHEN event_id % 4 = 3 THEN 0.3 ELSE 0.0 END ELSE coalesce(CASE WHEN event_id % 5 > 0 THEN user_id % 101 END, 50) / 100.0 END AS score FROM events)
    SELECT event_id, {r('CAST(score AS DOUBLE)')} AS score, score >= CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.6 END AS passed, CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'heuristic' ELSE 'llm' END AS grader FROM g""",
)
def grade_dispatch(spark, d):
    bench = F.get(F.array(F.lit("gaia"), F.lit("toolbench"), F.lit("swebench")), (F.col("event_id") % 3).cast("int"))
    score = F.when(F.col("event_id") % 5 > 0, (F.col("user_id") % 101).cast("double"))
    made = text.grade(bench, F.expr(_ANSWERED), F.col("user_id").cast("string"), F.lit(0), score)
    return table(spark, d, "events").select("event_id", made.alias("g")).select("event_id", "g.*")


@query("final_answers", "WITH t AS (SELECT conv_id, bool_or(role = 'assistant' AND turn = 5 AND turn % 3 > 0) AS fin, arg_max(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN NULL ELSE text END, turn) FILTER (WHERE NOT (role = 'assistant' AND turn % 3 = 0) AND text <> '' AND NOT starts_with(trim(text), '{')) AS spoken, max(turn) FILTER (WHERE NOT (role = 'assistant' AND turn % 3 = 0) AND text <> '' AND NOT starts_with(trim(text), '{')) AS place, arg_max(coalesce(text, ''), turn) AS last FROM conversations GROUP BY 1) SELECT conv_id AS trajectory_id, CASE WHEN fin AND place <= 5 THEN 'done' ELSE coalesce(spoken, last) END AS answer FROM t")
def final_answers(spark, d):
    return trajectories(spark, d).select("trajectory_id", text.final_answer(F.col("steps")).alias("answer"))


_FLAGS = ["user_id % 2 = 0", "user_id % 3 = 0", "user_id % 5 < 4", "event_id % 3 > 0", "event_id % 4 = 0"]


@query("replay_tiers", f"SELECT event_id, CASE WHEN {_FLAGS[0]} AND {_FLAGS[1]} AND {_FLAGS[2]} THEN 1 WHEN {_FLAGS[3]} AND {_FLAGS[2]} THEN 2 WHEN {_FLAGS[4]} OR {_FLAGS[2]} THEN 3 END AS tier FROM events")
def replay_tiers(spark, d):
    return table(spark, d, "events").select("event_id", text.replay_tier(*map(F.expr, _FLAGS)).alias("tier"))


@query("capabilities", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true ELSE false END AS can_replay, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 3 < 2 THEN true ELSE false END AS verifier, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END AS tier FROM events")
def capabilities(spark, d):
    bench = F.get(F.array(F.lit("SWEbench"), F.lit("gaia"), F.lit("toolbench")), (F.col("event_id") % 3).cast("int"))
    override = F.when(F.col("event_id") % 5 == 0, True)
    return table(spark, d, "events").select("event_id", text.capability(bench, "can_replay").alias("can_replay"), text.capability(bench, "has_objective_verifier", override).alias("verifier"), text.default_tier(bench).alias("tier"))


@query("swe_difficulty", "WITH d AS (SELECT doc_id, doc_id % 9 AS n, n_chars % 2500 AS size, doc_id % 4 AS files FROM documents) SELECT doc_id, CASE WHEN n <= 4 AND (CASE WHEN size > 0 AND files > 0 THEN files WHEN size > 0 OR files > 0 THEN files ELSE 1 END) = 1 AND size + files * 10 < 500 THEN 'easy' WHEN n <= 7 AND (CASE WHEN size + files = 0 THEN 1 ELSE files END) <= 2 AND size + files * 10 < 2000 THEN 'medium' ELSE 'hard' END AS difficulty FROM d")
def swe_difficulty(spark, d):
    patch = F.concat(F.repeat(F.lit("diff --git"), (F.col("doc_id") % 4).cast("int")), F.repeat(F.lit("x"), (F.col("n_chars") % 2500).cast("int")))
    return table(spark, d, "documents").select("doc_id", text.swe_difficulty(F.col("doc_id") % 9, patch).alias("difficulty"))


_IDS = "concat('x_', doc_id, CASE doc_id % 4 WHEN 0 THEN '_ToolBench' WHEN 1 THEN '_gaia' WHEN 2 THEN '_SWE' ELSE '' END)"


@query("composite_ids", f"SELECT doc_id, concat_ws('_', lang, source, CAST(doc_id AS VARCHAR)) AS composite, CASE doc_id % 4 WHEN 0 THEN 'toolbench' WHEN 1 THEN 'gaia' WHEN 2 THEN 'swebench' ELSE 'unknown' END AS benchmark, doc_id AS k, concat('eval::', {_IDS}, '::007') AS unit, doc_id % 2 = 0 AS valid FROM documents")
def composite_ids(spark, d):
    suffix = text.config_suffix(F.concat(F.lit('{"k": '), F.col("doc_id").cast("string"), F.lit("}")))
    unit = text.unit_id(F.expr(_IDS), F.lit(7))
    back = F.get_json_object(text.config_of(F.concat_ws("_", F.lit("id"), suffix)), "$.k").cast("bigint")
    checked = text.is_unit_id(F.when(F.col("doc_id") % 2 == 0, unit).otherwise("eval::x"))
    return table(spark, d, "documents").select("doc_id", text.composite_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("composite"), text.benchmark_of(F.expr(_IDS)).alias("benchmark"), back.alias("k"), unit.alias("unit"), checked.alias("valid"))


@query(
    "degradation",
    f"""SELECT l_orderkey, l_linenumber, {r('l_quantity / 50 - l_discount * 10')} AS od, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_returnflag = 'R' AS INT) - CAST(l_linestatus = 'O' AS INT) END AS binary_od, CASE WHEN l_linenumber = 7 THEN 0.5 WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS outcome,
    CASE WHEN l_linenumber % 4 = l_partkey % 4 THEN 'exact' WHEN abs(l_linenumber % 4 - l_partkey % 4) <= 1 THEN 'near' ELSE 'wrong' END AS localization FROM (SELECT * REPLACE (l_partkey % 5 AS l_partkey) FROM lineitem)""",
)
def degradation(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_partkey", F.col("l_partkey") % 5)
    success = F.when(F.col("l_linenumber") != 7, F.col("l_returnflag") == "R")
    step = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return rows.select(
        "l_orderkey", "l_linenumber", scoring.outcome_degradation(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("od"), scoring.binary_degradation(success, F.col("l_linestatus") == "O").alias("binary_od"), scoring.baseline_outcome(success).alias("outcome"),
        scoring.localization_class(step(F.col("l_partkey") % 4), step(F.col("l_linenumber") % 4), F.array(*map(F.lit, ("s0", "s1", "s2", "s3")))).alias("localization"),
    )


@query(
    "semantic_diff",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN user_id % 2 = 0 WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS differs FROM events""",
)
def semantic_diff(spark, d):
    """Steps whose outputs differ in blanks and case, in numbers by little or much, in kind, or not at all."""
    a = """CASE event_id % 6 WHEN 0 THEN '{"observation": " Done "}' WHEN 1 THEN '{"extracted_value": 1.5}' WHEN 2 THEN '{"tool_output": {"a": 1}}' WHEN 3 THEN '{"content": "1"}' WHEN 4 THEN '{"content": "x"}' ELSE '{"observation": null, "content": "x"}' END"""
    b = """CASE event_id % 6 WHEN 0 THEN '{"content": "done"}' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN '{"extracted_value": 1.6}' ELSE '{"extracted_value": 1.5005}' END WHEN 2 THEN '{"tool_output": {"a": 1}}' WHEN 3 THEN '{"content": 1}' WHEN 4 THEN '{}' ELSE '{"other": 1}' END"""
    return table(spark, d, "events").select("event_id", scoring.outputs_differ(scoring.step_output(F.expr(a)), scoring.step_output(F.expr(b))).alias("differs"))


@query("interpretations", f"WITH {FACTS_SQL} SELECT DISTINCT {r('outcome_degradation')} AS s, {r('predicted_impact / 2')} AS e, CASE WHEN outcome_degradation > 0.5 AND predicted_impact / 2 < 0.1 THEN 'strong' WHEN outcome_degradation BETWEEN 0.2 AND 0.5 AND predicted_impact / 2 BETWEEN 0.1 AND 0.3 THEN 'moderate' WHEN outcome_degradation < 0.15 OR predicted_impact / 2 > 0.3 THEN 'poor' ELSE 'mixed' END AS band FROM facts WHERE outcome_degradation IS NOT NULL")
def interpretations(spark, d):
    rows = facts(spark, d).filter("outcome_degradation is not null").select(F.col("outcome_degradation").alias("s"), (F.col("predicted_impact") / 2).alias("e"))
    return rounded(rows.select("s", "e", scoring.interpretation(F.col("s"), F.col("e")).alias("band"))).distinct()


@query("unit_flags", f"WITH {FACTS_SQL} SELECT unit_id, order_id, perturbation_class = 'placebo' AS is_placebo, expected_impact = 3 AS is_high_impact, expected_detectability <= 1 AS is_subtle FROM facts")
def unit_flags(spark, d):
    return perturbation.unit_flags(facts(spark, d)).select("unit_id", "order_id", "is_placebo", "is_high_impact", "is_subtle")


@query("class_family_validity", f"WITH {FACTS_SQL} SELECT perturbation_class, perturbation_family, perturbation_type, coalesce({' OR '.join(f'''(perturbation_class = '{c}' AND perturbation_family IN {f})''' for c, f in perturbation.FAMILIES.items())}, false) AS pair_ok, coalesce({' OR '.join(f'''(perturbation_family = '{f}' AND perturbation_type IN {t})''' for f, t in perturbation.TYPES.items())}, false) AS type_ok, count(*) AS n FROM facts GROUP BY ALL")
def class_family_validity(spark, d):
    rows = facts(spark, d).groupBy("perturbation_class", "perturbation_family", "perturbation_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns({"pair_ok": perturbation.valid_pair(F.col("perturbation_class"), F.col("perturbation_family")), "type_ok": perturbation.valid_type(F.col("perturbation_family"), F.col("perturbation_type"))})


@query("prompt_render", "SELECT doc_id, concat('Task ', lang, ' of ', source, ': {{other}} ') AS prompt FROM documents")
def prompt_render(spark, d):
    made = text.rendered(F.lit("Task {{lang}} of {{source}}: {{other}} {{none}}"), {"lang": F.col("lang"), "source": F.col("source"), "none": F.lit(None)})
    return table(spark, d, "documents").select("doc_id", made.alias("prompt"))


@query("domains", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN 'web_framework' ELSE 'general_python' END WHEN 1 THEN CASE doc_id % 2 WHEN 0 THEN 'calculation' ELSE 'general_qa' END ELSE CASE doc_id % 2 WHEN 0 THEN 'data_information' ELSE 'other' END END AS domain FROM documents")
def domains(spark, d):
    even = F.col("doc_id") % 2 == 0
    bench = F.get(F.array(F.lit("SWEbench"), F.lit("gaia"), F.lit("toolbench")), (F.col("doc_id") % 3).cast("int"))
    made = text.domain(bench, F.array(F.when(even, "Weather_api").otherwise("nothing")), F.when(even, "Django/django").otherwise("x/y"), F.when(even, "Please compute").otherwise("hello"))
    return table(spark, d, "documents").select("doc_id", made.alias("domain"))


# -- joins and samples -------------------------------------------------------------
@query(
    "evaluations_with_od",
    f"""WITH {FACTS_SQL}, p AS (SELECT order_id AS t, outcome_degradation AS od, sample FROM facts WHERE outcome_degradation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY sample DESC, unit_id DESC) = 1)
    SELECT o_orderkey AS trajectory_id, CASE WHEN o_orderkey % 5 = 0 THEN 50.0 ELSE {r('o_totalprice')} END AS score, {r('od')} AS od FROM orders JOIN p ON t = o_orderkey""",
)
def evaluations_with_od(spark, d):
    evaluations = table(spark, d, "orders").select(F.col("o_orderkey").alias("trajectory_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("score"))
    rows = facts(spark, d).select(F.col("order_id").alias("perturbed_trajectory_id"), F.col("outcome_degradation").alias("od"), F.struct("sample", "unit_id").alias("ord"))
    return relational.evaluations_with_od(evaluations, rows)


@query(
    "unit_judgments",
    """WITH j AS (SELECT user_id AS unit_id, event_type AS version, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
    SELECT c_custkey AS unit_id, c_nationkey AS trajectory_id, version, value, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 0 END, 1) AS class_matches, CASE WHEN c_nationkey % 4 = 0 THEN false ELSE true END AS clean_baseline FROM customer JOIN j ON j.unit_id = c_custkey""",
)
def unit_judgments(spark, d):
    customers = table(spark, d, "customer")
    units = customers.select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("trajectory_id"))
    judgments = table(spark, d, "events").select(F.col("user_id").alias("unit_id"), F.col("event_type").alias("version"), F.col("event_id").alias("at"), "value")
    validation = units.filter("unit_id % 3 = 0").select("unit_id", F.lit(0).alias("class_matches"))
    baselines = table(spark, d, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("trajectory_id"), F.lit(False).alias("clean_baseline"))
    return relational.join_judgments(units, judgments, validation, baselines).select("unit_id", "trajectory_id", "version", "value", "class_matches", "clean_baseline")


_KEY = "md5(concat('42:', doc_id))"


@query("class_sample", f"""WITH {FACTS_SQL}, p AS (SELECT unit_id AS id, max(perturbation_class) AS c FROM facts WHERE expected_detectability > 0 GROUP BY 1 HAVING count(*) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5(concat('42:', id)), id) AS k FROM p)
    SELECT id AS perturbation_id, c AS perturbation_class FROM k WHERE k <= CASE c WHEN 'placebo' THEN 40 WHEN 'fine_grained' THEN 100 ELSE 60 END""")
def class_sample(spark, d):
    rows = facts(spark, d).select(F.col("unit_id").alias("perturbation_id"), "perturbation_class", (F.col("expected_detectability") > 0).alias("is_primary_for_experiment"))
    once = rows.filter("is_primary_for_experiment").groupBy("perturbation_id").agg(F.max("perturbation_class").alias("perturbation_class"), F.count(F.lit(1)).alias("n")).filter("n = 1").withColumn("is_primary_for_experiment", F.lit(True))
    return sampling.class_sample(once, 200, {"placebo": 0.2, "fine_grained": 0.5, "coarse_grained": 0.3}).select("perturbation_id", "perturbation_class")


@query("domain_caps", f"WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) AS k FROM documents) SELECT doc_id, source AS domain FROM k WHERE k <= CASE source WHEN 'src3' THEN 20 WHEN 'src1' THEN 5 ELSE 100 END ORDER BY {_KEY}, doc_id LIMIT 100")
def domain_caps(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("domain"))
    return sampling.domain_caps(rows, 100, {"src3": 0.2, "src1": 0.05}, key="doc_id")


@query("complexity_rebalance", f"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY {_KEY}, doc_id) AS k FROM c)
    SELECT doc_id, complexity FROM k WHERE k <= CASE complexity WHEN 'simple' THEN 20 WHEN 'medium' THEN 50 ELSE 30 END""")
def complexity_rebalance(spark, d):
    kind = F.get(F.array(F.lit("simple"), F.lit("medium"), F.lit("complex")), (F.col("doc_id") % 3).cast("int"))
    return sampling.complexity_rebalance(table(spark, d, "documents").select("doc_id", kind.alias("complexity")), 100, key="doc_id")


@query("dealt_hands", f"""WITH c AS (SELECT doc_id, (row_number() OVER (ORDER BY {_KEY}, doc_id) - 1) // 7 AS turn FROM documents), h AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(concat('42:', c_custkey)), c_custkey) - 1 AS turn FROM customer)
    SELECT doc_id, c_custkey FROM c JOIN h USING (turn)""")
def dealt_hands(spark, d):
    return sampling.dealt(table(spark, d, "documents").select("doc_id"), table(spark, d, "customer").select("c_custkey"), "doc_id", "c_custkey", 7)


@query(
    "slots_of_steps",
    """WITH e AS (SELECT event_id, user_id, event_id % 3 AS k FROM events)
    SELECT event_id, 'tool_name' AS slot, 'tool' AS value_type, 'search_code' AS value, 'tool_selection' AS allowed FROM e WHERE k = 0
    UNION ALL SELECT event_id, 'tool_arguments.limit', 'integer', CAST(user_id AS VARCHAR), 'parameter,data_reference' FROM e WHERE k = 0
    UNION ALL SELECT event_id, 'extracted_value', 'line_number', CAST(user_id AS VARCHAR), 'data_reference' FROM e WHERE k = 1
    UNION ALL SELECT event_id, 'final_answer', 'string', concat('it is ', user_id), 'data_reference' FROM e WHERE k = 2""",
)
def slots_of_steps(spark, d):
    of = lambda *options: F.get(F.array(*[F.lit(o) if not hasattr(o, "alias") else o for o in options]), (F.col("event_id") % 3).cast("int"))
    none = F.lit(None).cast("string")
    user = F.col("user_id").cast("string")
    rows = table(spark, d, "events").select(
        "event_id", of("tool_call", "extraction", "final_response").alias("step_role"), of(F.lit("search_code"), none, F.lit("Finish")).alias("tool_name"), of(F.concat(F.lit('{"limit": '), user, F.lit("}")), none, none).alias("tool_arguments"),
        of(none, user, none).alias("extracted_value"), of(none, F.lit("line_number"), none).alias("value_type"), (F.col("event_id") % 3 == 2).alias("produces_final_answer"), of(F.lit("x"), F.lit("y"), F.concat(F.lit("So the answer: it is "), user)).alias("raw_text"),
    )
    return typing.step_slots(rows, ["event_id"]).withColumn("allowed", F.array_join("allowed", ","))
