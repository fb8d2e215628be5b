"""Queries over ordered steps: pairing, windows, typing, dependencies, criticality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import typing
from ..sources import table
from ..sources.parsers import paired_turns
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


@query("conversation_bands", "WITH p AS (SELECT conv_id, count(*) AS n_steps, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY 1) SELECT CASE WHEN n_steps <= 4 THEN 'simple' WHEN n_steps <= 6 THEN 'medium' ELSE 'complex' END AS complexity, count(*) AS n, CAST(sum(n_user) AS BIGINT) AS user_turns FROM p GROUP BY 1")
def conversation_bands(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("role") == "user").alias("n_user"))
    from ..functions.text import complexity

    return per.groupBy(complexity(F.col("n_steps")).alias("complexity")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_user").alias("user_turns"))


@query("lead_pairing", "SELECT conv_id, turn, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user'")
def lead_pairing(spark, d):
    pairs = paired_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", caller="user", callee="assistant")
    return pairs.select("conv_id", "turn", F.col("tool_output").alias("answer"))


@query("prior_nonnull", "SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM conversations")
def prior_nonnull(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(by).alias("source"))


@query("terminal_step", "SELECT conv_id, coalesce(min(turn) FILTER (WHERE contains(lower(text), 'the end')), max(turn)) AS terminal FROM conversations GROUP BY 1")
def terminal_step(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.contains(F.lower("text"), F.lit("the end")), F.col("turn"))), F.max("turn")).alias("terminal"))


def edges(spark, d) -> DataFrame:
    """A step depends on the one before it, and every third one also on the first."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("trajectory_id"), (F.col("turn") + 1).alias("step_index"))
    before = turns.filter("step_index > 1 and step_index <> 4").withColumn("source_step", F.col("step_index") - 1)
    return before.unionByName(turns.filter("step_index % 3 = 0").withColumn("source_step", F.lit(1).cast("bigint"))).distinct()


_EDGES = """e AS (SELECT conv_id AS t, turn + 1 AS s, turn AS d FROM conversations WHERE turn >= 1 AND turn <> 3 UNION SELECT conv_id, turn + 1, 1 FROM conversations WHERE (turn + 1) % 3 = 0),
up(t, s, a) AS (SELECT t, s, d FROM e UNION SELECT up.t, up.s, e.d FROM up JOIN e ON up.t = e.t AND up.a = e.s)"""


@query("closure_recursive", f"WITH RECURSIVE {_EDGES} SELECT t AS trajectory_id, s AS step_index, a AS ancestor FROM up")
def closure_recursive(spark, d):
    closed = typing.closure(edges(spark, d))
    return closed.select("trajectory_id", "step_index", F.explode("ancestors").alias("ancestor"))


@query("closure_sql", f"WITH RECURSIVE {_EDGES} SELECT t AS trajectory_id, s AS node, a AS ancestor FROM up")
def closure_sql(spark, d):
    edges(spark, d).createOrReplaceTempView("_edges")
    return typing.closure_recursive(spark, "_edges")


@query("fanout", f"WITH RECURSIVE {_EDGES} SELECT up.t AS trajectory_id, up.a AS step_index, CAST(sum(CASE WHEN e.s IS NULL THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS fan_out, count(*) AS dependants FROM up LEFT JOIN e ON e.t = up.t AND e.s = up.s AND e.d = up.a GROUP BY 1, 2")
def fanout(spark, d):
    rows = edges(spark, d)
    return typing.fan_out(rows, typing.closure(rows))


@query(
    "criticality",
    """WITH x AS (SELECT conv_id, turn + 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations),
    b AS (SELECT *, CASE WHEN i = n THEN greatest(CASE role WHEN 'user' THEN 0.8 WHEN 'assistant' THEN 0.7 ELSE 0.5 END, 0.95) ELSE CASE role WHEN 'user' THEN 0.8 WHEN 'assistant' THEN 0.7 ELSE 0.5 END END AS base FROM x)
    SELECT conv_id, i AS step_index, round(CAST(greatest(0.0, least(1.0, base * (1 - CAST(i AS DOUBLE) / n * 0.1) + least(0.2, (n - i) * 0.05))) AS DOUBLE), 3) + 0.0 AS score FROM b""",
)
def criticality(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("step_index"), F.when(F.col("role") == "user", "planning").when(F.col("role") == "assistant", "tool_call").otherwise("reasoning").alias("r"))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    last = F.col("step_index") == F.col("n")
    rows = turns.withColumn("n", n)
    return rows.select("conv_id", "step_index", typing.criticality(F.col("r"), (F.col("n") - F.col("step_index")).cast("double"), F.col("step_index"), F.col("n"), last, F.lit(False)).alias("score"))


@query("typed_steps")
def typed_steps(spark, d):
    """All typing passes over conversations as trajectories."""
    turns = table(spark, d, "conversations")
    call = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    steps = turns.select(
        F.col("conv_id").cast("string").alias("trajectory_id"), (F.col("turn") + 1).cast("int").alias("step_index"), F.col("text").alias("raw_text"), F.when(call, "search_code").alias("tool_name"),
        F.when(call, '{"query": "x", "path": "/src/app/main.py"}').alias("tool_arguments"), F.when(call, F.col("text")).alias("observation"), F.lit("reasoning").alias("step_type"), F.lit("swebench").alias("benchmark"),
    )
    rows, _ = typing.typed(steps)
    return rows.select("trajectory_id", "step_index", "step_role", "normalized_operation", "is_terminal_step", "critical_path_score", "affects_final_answer", "recoverable_if_wrong", F.size("produced_artifacts").alias("n_artifacts"), F.col("fan_out"))


@query("dependency_edges")
def dependency_edges(spark, d):
    turns = table(spark, d, "conversations")
    steps = turns.select(F.col("conv_id").cast("string").alias("trajectory_id"), (F.col("turn") + 1).cast("int").alias("step_index"), F.concat("text", F.lit(" as in step "), F.col("turn")).alias("raw_text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_arguments"), F.lit(None).cast("string").alias("observation"), F.lit("reasoning").alias("step_type"), F.lit("gaia").alias("benchmark"))
    return typing.typed(steps)[1]


@query("propagation_depth", "WITH t AS (SELECT conv_id, list(lower(trim(text)) ORDER BY turn) FILTER (WHERE role = 'user') AS b, list(lower(trim(text)) ORDER BY turn) FILTER (WHERE role <> 'user') AS p FROM conversations GROUP BY 1) SELECT conv_id, CAST(len(list_filter(range(1, least(len(b), len(p))), lambda i: b[i + 1] <> p[i + 1])) + greatest(len(p) - len(b), 0) AS INT) AS depth FROM t WHERE b IS NOT NULL AND p IS NOT NULL")
def propagation_depth(spark, d):
    turns = table(spark, d, "conversations")
    texts = lambda own: F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(texts(F.col("role") == "user").alias("b"), texts(F.col("role") != "user").alias("p")).filter((F.size("b") > 0) & (F.size("p") > 0))
    return rows.select("conv_id", scoring.propagation(F.col("b"), F.col("p"), F.lit(1))["depth"].alias("depth"))


@query(
    "typing_rejections",
    """WITH s AS (SELECT CASE WHEN conv_id % 9 = 8 THEN NULL ELSE concat('t', conv_id) END AS t, CASE WHEN length(text) % 23 = 0 THEN NULL WHEN length(text) % 29 = 0 THEN 0 ELSE turn END AS i,
        CASE length(text) % 13 WHEN 0 THEN '[1]' WHEN 1 THEN '{"a": 1' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE '{"a": 1}' END AS a, length(text) % 13 AS k, CASE WHEN length(text) % 31 = 0 THEN '' ELSE 'gaia' END AS b FROM conversations),
    f AS (SELECT t, i, CASE WHEN t IS NULL THEN 'no trajectory' WHEN i IS NULL THEN 'no step index' WHEN count(*) OVER (PARTITION BY t, i) > 1 THEN 'repeated step index' WHEN k < 2 THEN 'arguments are no object' WHEN b = '' THEN 'no benchmark' END AS e FROM s)
    SELECT t AS trajectory_id, arg_min(e, (coalesce(i, -1), e)) AS error, min(i) FILTER (WHERE true) AS step_index FROM (SELECT * FROM f WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(i, -1), e) = 1) GROUP BY t""",
)
def typing_rejections(spark, d):
    rows = table(spark, d, "conversations").selectExpr(
        "CASE WHEN conv_id % 9 = 8 THEN NULL ELSE concat('t', conv_id) END AS trajectory_id", "CAST(CASE WHEN length(text) % 23 = 0 THEN NULL WHEN length(text) % 29 = 0 THEN 0 ELSE turn END AS INT) AS step_index",
        """CASE length(text) % 13 WHEN 0 THEN '[1]' WHEN 1 THEN '{"a": 1' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE '{"a": 1}' END AS tool_arguments""", "CASE WHEN length(text) % 31 = 0 THEN '' ELSE 'gaia' END AS benchmark",
    )
    return typing.typing_errors(rows)
