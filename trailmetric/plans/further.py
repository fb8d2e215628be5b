"""Queries of effect sizes, typing helpers, nested reads and samples that draw in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import curation, metrics, perturbation, relational, sampling, statistics, typing
from ..sources import export, status, table
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


# -- effect sizes ----------------------------------------------------------------
_POSITION = "CASE sample % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END"
_TYPE = "CASE order_id % 5 WHEN 0 THEN 'planning' WHEN 1 THEN 'tool_selection' WHEN 2 THEN 'parameter' WHEN 3 THEN 'data_reference' ELSE 'other' END"
_CCG = "predicted_impact - outcome_degradation + CASE WHEN sample % 3 = 2 AND order_id % 5 IN (2, 3) THEN 0.9 WHEN sample % 3 = 0 AND order_id % 5 < 2 THEN -0.9 ELSE 0 END"
_SIDES = {
    "early_vs_late": ("p = 'early'", "p = 'late'"),
    "planning_vs_parameter": ("k = 'planning'", "k = 'parameter'"),
    "structural_vs_surface": ("k IN ('planning', 'tool_selection')", "k IN ('parameter', 'data_reference')"),
    "early_structural_vs_late_surface": ("p = 'early' AND k IN ('planning', 'tool_selection')", "p = 'late' AND k IN ('parameter', 'data_reference')"),
}
_EFFECTS = f"""WITH {FACTS_SQL}, x AS (SELECT {_POSITION} AS p, {_TYPE} AS k, {_CCG} AS v FROM facts WHERE outcome_degradation IS NOT NULL),
e AS ({' UNION ALL '.join(f"SELECT '{name}' AS contrast, count(*) FILTER (WHERE {a}) AS n1, count(*) FILTER (WHERE {b}) AS n2, avg(v) FILTER (WHERE {a}) AS m1, avg(v) FILTER (WHERE {b}) AS m2, var_samp(v) FILTER (WHERE {a}) AS v1, var_samp(v) FILTER (WHERE {b}) AS v2 FROM x" for name, (a, b) in _SIDES.items())}),
f AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM e)"""


def _gaps(spark, d):
    return facts(spark, d).select(F.expr(_POSITION).alias("position"), F.expr(_TYPE).alias("perturbation_type"), F.expr(_CCG).alias("ccg"))


@query("effect_contrasts", f"{_EFFECTS} SELECT contrast, n1, n2, {r('m1')} AS mean1, {r('m2')} AS mean2, {r('d')} AS d FROM f")
def effect_contrasts(spark, d):
    return statistics.effect_contrasts(_gaps(spark, d))


@query(
    "hypothesis",
    f"""{_EFFECTS}, h AS (SELECT *, m1 < 0 AS c1, m2 > 0 AS c2, m1 < m2 AS c3, abs(d) * sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE)) > 1.9604 AS c4, abs(d) > 0.5 AS c5 FROM f WHERE contrast = 'early_structural_vs_late_surface')
    SELECT {r('m1')} AS early_structural_mean, {r('m2')} AS late_surface_mean, {r('d')} AS d, {r('d * sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE))')} AS t, c1 AS early_under_penalized, c2 AS late_over_penalized, c3 AS direction_correct, c4 AS statistically_significant, c5 AS meaningful_effect_size,
      c1::INT + c2::INT + c3::INT + c4::INT + c5::INT AS criteria_met, CASE WHEN c1::INT + c2::INT + c3::INT + c4::INT + c5::INT >= 4 THEN 'strong' WHEN c1::INT + c2::INT + c3::INT + c4::INT + c5::INT = 3 THEN 'moderate' WHEN c1::INT + c2::INT + c3::INT + c4::INT + c5::INT = 2 THEN 'weak' ELSE 'not supported' END AS support FROM h""",
)
def hypothesis(spark, d):
    return statistics.assess_hypothesis(_gaps(spark, d)).drop("p_value")


# -- nested reads and texts ----------------------------------------------------------
@query("find_nested", "SELECT DISTINCT conv_id AS trajectory_id FROM conversations WHERE conv_id % 11 > 0 AND conv_id % 2 = 0")
def find_nested(spark, d):
    return relational.find(trajectories(spark, d), ground_truth__task_success=True, ground_truth__difficulty=None).select("trajectory_id")


@query("export_part", "SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 40")
def export_part(spark, d):
    docs = table(spark, d, "documents")
    return export(docs.select("doc_id", "lang", "n_chars"), F.col("lang") == "de", [F.desc("n_chars"), F.col("doc_id")], 40).select("doc_id", "lang")


@query("collection_status", "SELECT 'events' AS collection, (SELECT count(*) FROM events WHERE user_id = 3) AS n UNION ALL SELECT 'documents', (SELECT count(*) FROM documents)")
def collection_status(spark, d):
    return status({"events": table(spark, d, "events").withColumnRenamed("user_id", "experiment_id"), "documents": table(spark, d, "documents")}, 3)


@query("path_set", """SELECT event_id, CAST(user_id AS BIGINT) AS k FROM events""")
def path_set(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a": [1, {"k": 0}], "z": "x"}')).alias("doc"), F.lit("a[1].k").alias("path"), F.col("user_id").cast("string").alias("v"))
    return typing.with_path_set(rows, "doc", "path", "v", "out").select("event_id", F.get_json_object("out", "$.a[1].k").cast("bigint").alias("k"))


@query("first_present", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS picked FROM events")
def first_present(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind")).alias("meta"), F.col("event_type").alias("kind"))
    return rows.select("event_id", curation.first_present(["meta.none", "meta.kind", "kind"], rows).alias("picked"))


_LINES = "WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'search_code' WHEN role = 'assistant' AND turn = 5 THEN 'Finish' END AS tool FROM conversations)"


@query("trajectory_texts", f"{_LINES} SELECT conv_id AS trajectory_id, concat('Task: task', chr(10), string_agg(concat('Step ', turn + 1, ': ', coalesce(text, ''), CASE WHEN tool IS NOT NULL THEN concat(chr(10), 'Tool: ', tool) ELSE '' END, CASE WHEN tool IS NOT NULL AND conv_id % 5 > 0 AND text IS NOT NULL THEN concat(chr(10), 'Output: ', substr(text, 1, 200)) ELSE '' END), chr(10) ORDER BY turn)) AS rendered FROM t GROUP BY 1")
def trajectory_texts(spark, d):
    return trajectories(spark, d).select("trajectory_id", text.trajectory_text(F.col("ground_truth.task_description"), F.col("steps")).alias("rendered"))


@query("strict_reasons", "WITH t AS (SELECT conv_id, max(turn) AS m, bool_or(role = 'assistant' AND turn % 3 = 0 AND conv_id % 5 > 0 AND coalesce(text, '') NOT IN ('', '{}', '[]')) AS seen, bool_or(role = 'assistant' AND turn = 5) AS fin FROM conversations GROUP BY 1) SELECT conv_id AS trajectory_id, 'toolbench_strict:' || CASE WHEN conv_id % 11 = 0 OR conv_id % 2 = 1 THEN 'task_success_not_true' WHEN NOT (fin AND m = 5) THEN 'final_not_finish' WHEN NOT seen THEN 'no_real_tool_output' END AS reason FROM t")
def strict_reasons(spark, d):
    return trajectories(spark, d).select("trajectory_id", curation.strict_reason(F.col("steps"), F.col("ground_truth.task_success")).alias("reason"))


@query(
    "segmented_steps",
    """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'search_code' WHEN role = 'assistant' AND turn = 5 THEN 'Finish' END AS tool FROM conversations)
    SELECT conv_id AS trajectory_id, sum(CASE WHEN length(trim(text)) > 10 THEN 1 ELSE 0 END)::INT AS thoughts, count(tool)::INT AS actions, sum(CASE WHEN tool IS NOT NULL AND conv_id % 5 > 0 AND text <> '' THEN 1 ELSE 0 END)::INT AS observations FROM t GROUP BY 1""",
)
def segmented_steps(spark, d):
    parts = typing.segmented(F.col("steps"))
    count = lambda kind: F.size(F.filter(parts, lambda x: x["segmented_from"] == kind))
    return trajectories(spark, d).select("trajectory_id", count("thought").alias("thoughts"), count("action").alias("actions"), count("observation").alias("observations"))


@query("criticality_summary", "WITH s AS (SELECT user_id AS trajectory_id, round(value / (SELECT max(value) FROM events), 3) AS s FROM events) SELECT trajectory_id, CAST(round(avg(s), 3) AS DOUBLE) AS mean, max(s) AS max, min(s) AS min, count(*) FILTER (WHERE s >= 0.7) AS critical, round(avg(CAST(s >= 0.7 AS INT)), 3) AS critical_share FROM s GROUP BY 1")
def criticality_summary(spark, d):
    events = table(spark, d, "events")
    top = events.agg(F.max("value")).first()[0]  # one value
    return typing.criticality_summary(events.select(F.col("user_id").alias("trajectory_id"), F.round(F.col("value") / top, 3).alias("critical_path_score")))


@query("call_log_stats", f"SELECT count(*) AS calls, {r('avg(CAST(event_id % 7 > 0 AS INT))')} AS success_rate, CAST(sum(user_id) AS BIGINT) AS tokens, {r('avg(value)')} AS avg_ms FROM events")
def call_log_stats(spark, d):
    return metrics.call_log_stats(table(spark, d, "events").select((F.col("event_id") % 7 > 0).alias("ok"), F.col("user_id").alias("tokens"), F.col("value").alias("ms")))


@query("marker_equivalence", "SELECT event_id, event_id % 3 < 2 AS same FROM events")
def marker_equivalence(spark, d):
    before = F.concat(F.lit("take "), F.col("user_id"), F.lit(" of /a/b.txt"))
    after = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("use /a/b.txt and "), F.col("user_id"))).when(F.col("event_id") % 3 == 1, F.concat(before, F.lit(" 9999"))).otherwise(F.concat(F.lit("take "), F.col("user_id"), F.lit(" of /a/c.txt")))
    return table(spark, d, "events").select("event_id", perturbation.equivalent(before, after).alias("same"))


# -- samples ---------------------------------------------------------------------
_KEY = "md5(concat('42:', doc_id))"
_UNIFORM = f"((CAST(concat('0x', substr({_KEY}, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("weighted_sample", f"SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY -ln({_UNIFORM}) / n_chars, doc_id LIMIT 100")
def weighted_sample(spark, d):
    return sampling.weighted_without_replacement(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars").cast("double"), "doc_id", 100)


@query(
    "fair_shares",
    f"""WITH t AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY lang) AS ds, CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 30 ELSE 0 END AS want FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_KEY}, doc_id) AS k FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) AS j FROM k WHERE k <= ceil(2.0 * want / ds))
    SELECT doc_id, lang, source FROM i WHERE j <= want""",
)
def fair_shares(spark, d):
    return sampling.fair_shares(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", {"en": 40, "de": 20}, key="doc_id").select("doc_id", "lang", "source")


@query(
    "greedy_select",
    f"""WITH RECURSIVE {FACTS_SQL}, c AS (SELECT order_id AS t, unit_id, sample, perturbation_class AS c, predicted_impact AS score, row_number() OVER (PARTITION BY order_id ORDER BY predicted_impact DESC, unit_id) AS k FROM facts),
    g AS (SELECT t, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS steps, 1 AS p, 2 AS f, 1 AS o, '' AS id, false AS took FROM c WHERE k = 1
      UNION ALL SELECT t, k, CASE WHEN ok THEN list_append(steps, sample) ELSE steps END, p - CAST(ok AND c = 'placebo' AS INT), f - CAST(ok AND c = 'fine_grained' AS INT), o - CAST(ok AND c = 'coarse_grained' AS INT), unit_id, ok FROM
        (SELECT g.t, c.k, g.steps, g.p, g.f, g.o, c.sample, c.c, c.unit_id, CASE c.c WHEN 'placebo' THEN g.p WHEN 'fine_grained' THEN g.f ELSE g.o END AS room, CASE c.c WHEN 'placebo' THEN g.p WHEN 'fine_grained' THEN g.f ELSE g.o END > 0 AND (NOT list_contains(g.steps, c.sample) OR CASE c.c WHEN 'placebo' THEN g.p WHEN 'fine_grained' THEN g.f ELSE g.o END = 1) AS ok
         FROM g JOIN c ON c.t = g.t AND c.k = g.k + 1))
    SELECT g.t AS trajectory_id, c.unit_id AS candidate_id, c.sample AS step_index, c.c AS perturbation_class, {r('c.score')} AS score FROM g JOIN c ON c.t = g.t AND c.k = g.k WHERE took""",
)
def greedy_select(spark, d):
    rows = facts(spark, d).select(F.col("order_id").alias("trajectory_id"), F.col("unit_id").alias("candidate_id"), F.col("sample").alias("step_index"), "perturbation_class", F.col("predicted_impact").alias("score"))
    return sampling.greedy_select(rows, {"placebo": 1, "fine_grained": 2, "coarse_grained": 1})


# -- typing on texts whose type is known ------------------------------------------------
def _of(*options: str | None):
    """The option of a row by ``k``."""
    return F.get(F.array(*[F.lit(o).cast("string") for o in options]), F.col("k").cast("int"))


def _named(column: str, *values: str | None) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + f" END AS {column}"


_ROLES = ("final_response", "tool_call", "observation", "extraction", "planning", "decision", "reasoning", "tool_call", "planning")


@query("step_roles", f"WITH e AS (SELECT event_id, event_id % 9 AS k FROM events) SELECT event_id, {_named('step_role', *_ROLES)} FROM e")
def step_roles(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.col("event_id") % 9).select(
        "event_id", _of("Finish", "search", None, None, None, None, None, None, None).alias("tool_name"), _of("x", "I will go", "seen", "the answer is 42", "Let me plan this", "decided to go", "because of it", "xyz", "xyz").alias("raw_text"),
        _of("reasoning", "reasoning", "observation", "reasoning", "reasoning", "reasoning", "reasoning", "tool_execution", "planning").alias("step_type"), F.lit(None).cast("string").alias("observation"), F.when(F.col("k") == 4, 1).otherwise(5).alias("step_index"),
    )
    return rows.select("event_id", typing.step_role().alias("step_role"))


_OPERATIONS = ("read", "write", "submit", "write", "execute", "read", "reason", "submit")


@query("step_flags", f"WITH e AS (SELECT event_id, event_id % 8 AS k FROM events) SELECT event_id, {_named('normalized_operation', *_OPERATIONS)}, k = 1 AS produces_patch, k = 7 AS produces_final_answer, true AS is_terminal_step FROM e")
def step_flags(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.col("event_id") % 8).select(
        "event_id", F.col("event_id").alias("trajectory_id"), F.lit(1).alias("step_index"), _of("str_replace_editor", "str_replace_editor", "submit", "bash", "bash", "grep", None, "Finish").alias("tool_name"),
        _of('{"command": "view"}', '{"command": "create"}', None, '{"bash_command": "echo x > f"}', '{"bash_command": "ls"}', None, None, '{"return_type": "give_answer"}').alias("tool_arguments"), F.lit("reasoning").alias("step_role"), F.lit("swebench").alias("benchmark"),
    )
    return typing.with_flags(rows).select("event_id", "normalized_operation", "produces_patch", "produces_final_answer", "is_terminal_step")


@query(
    "extraction_fields",
    f"WITH e AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id, {_named('extracted_value', '7', '12', 'src/a.py', '2.5', '7')}, {_named('value_type', 'integer', 'line_number', 'filepath', 'float', 'integer')}, CASE WHEN k < 4 THEN 1 END AS source_step, {_named('step_role', 'extraction', 'extraction', 'extraction', 'extraction', 'reasoning')} FROM e",
)
def extraction_fields(spark, d):
    """Two steps to a trajectory: an observation (but for the last kind) and what is taken from it."""
    rows = table(spark, d, "events").withColumn("k", F.col("event_id") % 5).select("event_id", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("step_index"))
    first = F.col("step_index") == 1
    rows = rows.select(
        "event_id", F.col("event_id").alias("trajectory_id"), "step_index", F.when(first, "seen").otherwise(_of("it is (7)", "(0) on line 12", "file: src/a.py", "result (2.5)", "it is (7)")).alias("raw_text"),
        F.when(first & (F.col("k") < 4), "out").alias("observation"), F.when(first, "observation").otherwise("extraction").alias("step_role"),
    )
    return typing.with_extraction(rows).filter("step_index = 2").select("event_id", "extracted_value", "value_type", F.col("source_step").cast("int").alias("source_step"), "step_role")


@query(
    "edge_types",
    f"WITH e AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id, 1 AS source_step, {_named('type', 'uses_observation_from', 'follows_plan_from', 'uses_extracted_value_from', 'uses_observation_from', 'acts_on_entity_from')}, {_named('evidence', 'textual:step_1', 'textual:step_1', 'textual:step_1', 'textual:file:main.py', 'file_path:/src/app/abc')} FROM e",
)
def edge_types(spark, d):
    """Two steps to a trajectory, the second of which names the first, its plan, its value, its file, or shares a path with it."""
    rows = table(spark, d, "events").withColumn("k", F.col("event_id") % 5).select("event_id", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("step_index"))
    first = F.col("step_index") == 1
    none = F.lit(None).cast("string")
    rows = rows.select(
        F.col("event_id").alias("trajectory_id"), F.col("step_index"), F.when(first, _of("start", "start", "start", "see /src/app/main.py", "see /src/app/abc")).otherwise(_of("look at step 1", "as planned in step 1", "the result is from step 1", "edit /src/app/main.py", "edit /src/app/abc")).alias("raw_text"),
        none.alias("tool_name"), none.alias("tool_arguments"), none.alias("extracted_value"), F.lit("reasoning").alias("step_role"), F.lit(None).cast("int").alias("source_step"),
        F.expr("cast(array() as array<string>)").alias("consumed_artifacts"), F.expr("cast(array() as array<struct<name: string, artifact_type: string>>)").alias("produced_artifacts"),
    )
    return typing.dependency_edges(rows).select(F.col("trajectory_id").alias("event_id"), "source_step", "type", "evidence")
