import json

import pytest
from pyspark.sql import functions as F

from trailmetric.operators import calls


def units(spark, n=6):
    return spark.createDataFrame([(f"u{i}",) for i in range(n)] + [(None,)], "unit string")


def answering():
    """Fails whole batches that hold u1 or u3, and u3 by itself also."""

    def call(frame):
        if frame["unit"].isin(["u3"]).any() or (len(frame) > 1 and frame["unit"].isin(["u1"]).any()):
            raise RuntimeError("refused")
        return ["said " + r for r in frame["request_id"]]

    return call


def test_requests(spark):
    rows = calls.requests(units(spark, 1), "unit", "judge", samples=2, version="v1").orderBy("sample_index").collect()
    assert [r.request_id for r in rows] == ["v1_judge_u0_judge_0", "v1_judge_u0_judge_1"]
    assert calls.requests(units(spark, 1), "unit", "j").first().request_id == "judge_u0_j_0"


def test_outcomes_and_what_is_pending(spark):
    attempts = spark.createDataFrame([("a", 1, None, "failed", "x"), ("a", 2, "yes", "success", None), ("a", 3, "later", "success", None), ("b", 1, None, "failed", "x"), ("b", 2, None, "failed", "y"), ("c", 1, None, "failed", "z")], calls.ATTEMPT)
    found = {r.request_id: (r.attempts, r.status, r.response, r.error) for r in calls.outcomes(attempts).collect()}
    assert found == {"a": (3, "success", "yes", None), "b": (2, "failed", None, "y"), "c": (1, "failed", None, "z")}
    asked = spark.createDataFrame([(x,) for x in "abcd"], "request_id string")
    assert sorted((r.request_id, r.attempt) for r in calls.pending(asked, attempts, retries=1).collect()) == [("c", 2), ("d", 1)]
    assert [(r.request_id, r.error) for r in calls.dead_letters(asked, attempts, retries=1).collect()] == [("b", "y")]
    assert calls.outcomes(attempts.limit(0)).count() == 0 and calls.pending(asked, attempts.limit(0)).count() == 4


def test_bad_row_fails_alone_and_is_retried(spark, tmp_path):
    asked = calls.requests(units(spark), "unit", "j")
    found = {r.request_id: r for r in calls.run_pending(asked, answering(), str(tmp_path / "a"), retries=1).collect()}
    assert {k: r.attempts for k, r in found.items() if r.status == "failed"} == {"judge_u3_j_0": 2} and len(found) == 6
    assert found["judge_u3_j_0"].error == "RuntimeError: refused" and found["judge_u1_j_0"].response == "said judge_u1_j_0"
    # Again: nothing is left to call. With another retry, only the lost one.
    def never(frame):
        raise AssertionError("called again")

    assert {r.status for r in calls.run_pending(asked, never, str(tmp_path / "a"), retries=1).collect()} == {"success", "failed"}
    again = {r.request_id: r.attempts for r in calls.run_pending(asked, lambda f: ["now"] * len(f), str(tmp_path / "a"), retries=2).collect()}
    assert again["judge_u3_j_0"] == 3 and sum(again.values()) == 8
    more = calls.run_pending(calls.requests(units(spark, 8), "unit", "j"), lambda f: ["new"] * len(f), str(tmp_path / "a"), retries=2)
    assert more.filter("status = 'success'").count() == 8


def test_wrong_number_of_responses_is_a_failure(spark):
    todo = calls.pending(calls.requests(units(spark, 2), "unit", "j"), spark.createDataFrame([], calls.ATTEMPT))
    assert all(r.status == "failed" and r.error.startswith("ValueError") for r in calls.attempted(todo, lambda f: ["x"] * 3).collect())
    assert {r.error for r in calls.attempted(todo, lambda f: [None] * len(f)).collect()} == {"no response"}


def test_stream_records_once_and_retries(spark, tmp_path):
    """Two files hold the same requests: what failed in the first is tried again in the second; a repeated start adds nothing."""
    source, folder = tmp_path / "in", tmp_path / "out"
    asked = calls.requests(units(spark), "unit", "j")
    for _ in range(2):
        asked.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(asked.schema).parquet(str(source))
        calls.stream_calls(stream, answering(), str(folder), str(tmp_path / "cp")).awaitTermination()
    rows = calls.recorded(spark, str(folder))
    assert rows.count() == 7 and rows.filter("status = 'success'").select("request_id").distinct().count() == 5
    stream = spark.readStream.schema(asked.schema).parquet(str(source))
    calls.stream_calls(stream, answering(), str(folder), str(tmp_path / "cp")).awaitTermination()
    assert calls.recorded(spark, str(folder)).count() == 7


@pytest.mark.parametrize(
    "said,want",
    [
        (json.dumps({"mutated_value": 7, "reasoning": "why"}), ("7", "llm_generated", "why", True)),
        ('ok\n```json\n{"mutated_value": "x", "mutation_type": "swap"}\n```', ("x", "swap", None, True)),
        ('so {"mutation_type": "swap"} there', ("old", "swap", None, True)),
        ("{}", ("old", "llm_parse_failed", "LLM response could not be parsed", False)),
        ("nothing", ("old", "llm_parse_failed", "LLM response could not be parsed", False)),
        (None, ("old", "llm_parse_failed", "LLM response could not be parsed", False)),
    ],
)
def test_mutation(spark, said, want):
    row = spark.createDataFrame([(said,)], "r string").select(calls.mutation(F.col("r"), F.lit("old")).alias("m")).first().m
    assert tuple(row) == want
