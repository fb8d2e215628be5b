"""Queries of requests to outside services and what was recorded of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls
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


SAMPLES, RETRIES = 3, 2
#: Attempts from line items, the same text in both engines.
_ATTEMPT = {
    "request_id": "concat('v1_judge_', l_orderkey, '_judge_a_', l_linenumber % 3)",
    "attempt": "CAST(floor(l_linenumber / 3.0) + 1 AS INT)",
    "response": "CASE WHEN l_quantity > 35 THEN concat(l_returnflag, ' ', l_partkey) END",
    "status": "CASE WHEN l_quantity > 35 THEN 'success' ELSE 'failed' END",
    "error": "CASE WHEN l_quantity > 35 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'timeout' ELSE 'refused' END",
}
_SQL = f"""WITH q AS (SELECT o_orderkey AS unit_id, i AS sample_index, concat('v1_judge_', o_orderkey, '_judge_a_', i) AS request_id FROM orders, range({SAMPLES}) x(i)),
a AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _ATTEMPT.items())} FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY status = 'success' DESC, CASE WHEN status = 'success' THEN attempt ELSE -attempt END, response, error DESC) AS place, max(attempt) OVER (PARTITION BY request_id) AS attempts FROM a),
o AS (SELECT request_id, attempts, status, response, CASE WHEN status = 'failed' THEN error END AS error FROM n WHERE place = 1) """


def _requests(spark, d):
    return calls.requests(table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id")), "unit_id", "judge_a", SAMPLES, "v1")


def _attempts(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _ATTEMPT.items()])


@query("call_outcomes", _SQL + "SELECT * FROM o")
def call_outcomes(spark, d):
    return calls.outcomes(_attempts(spark, d))


@query("pending_calls", _SQL + f"SELECT q.*, coalesce(attempts, 0) + 1 AS attempt FROM q LEFT JOIN o USING (request_id) WHERE coalesce(status, '') <> 'success' AND coalesce(attempts, 0) <= {RETRIES}")
def pending_calls(spark, d):
    return calls.pending(_requests(spark, d), _attempts(spark, d), RETRIES)


@query("dead_letters", _SQL + f"SELECT q.*, attempts, error FROM q JOIN o USING (request_id) WHERE status = 'failed' AND attempts > {RETRIES}")
def dead_letters(spark, d):
    return calls.dead_letters(_requests(spark, d), _attempts(spark, d), RETRIES)


#: Answers of five shapes about whole texts, the same text in both engines: bare, fenced, inside words, without the value, none.
_SAID = "concat(chr(123), '\"mutated_value\": \"', replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' '), '\", \"reasoning\": \"r', turn, '\"', chr(125))"
_ANSWER = f"""CASE (conv_id + turn) % 5 WHEN 0 THEN {_SAID} WHEN 1 THEN concat('Sure:', chr(10), '```json', chr(10), {_SAID}, chr(10), '```') WHEN 2 THEN concat('I say ', {_SAID}, ' so.')
  WHEN 3 THEN concat(chr(123), '"mutation_type": "', role, '"', chr(125)) ELSE text END"""


@query(
    "mutation_responses",
    f"""WITH s AS (SELECT conv_id, turn, concat('old_', turn) AS current, {_ANSWER} AS answer FROM conversations),
    j AS (SELECT *, nullif(regexp_extract(answer, '(?s)\\{{.*\\}}', 0), '') AS block FROM s), k AS (SELECT *, CASE WHEN json_valid(block) THEN CAST(block AS JSON) END AS v FROM j)
    SELECT conv_id, turn, coalesce(v ->> '$.mutated_value', current) AS mutated_value, CASE WHEN v IS NULL THEN 'llm_parse_failed' ELSE coalesce(v ->> '$.mutation_type', 'llm_generated') END AS mutation_type,
    CASE WHEN v IS NULL THEN 'LLM response could not be parsed' ELSE v ->> '$.reasoning' END AS reasoning, v IS NOT NULL AS parse_success FROM k""",
)
def mutation_responses(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat('old_', turn) AS current", f"{_ANSWER} AS answer")
    return rows.select("conv_id", "turn", calls.mutation(F.col("answer"), F.col("current")).alias("m")).select("conv_id", "turn", "m.*")
