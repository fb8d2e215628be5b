"""Loading of parsed trajectories, and closures of long chains, on small frames."""

import pytest
from pyspark.sql import functions as F

from trailmetric.operators import curation, typing

STEP = "struct<step_number:int,step_type:string,content:string,tool_name:string,tool_input:string,tool_output:string>"
SCHEMA = f"trajectory_id string, benchmark string, steps array<{STEP}>, ground_truth struct<task_success:boolean,difficulty:string,expected_answer:string>, final_answer string"


def step(i, tool=None, args=None, out=None, kind="reasoning", text="I think so"):
    return (i, kind, text, tool, args, out)


def frame(spark, *rows):
    return spark.createDataFrame([(name, "toolbench", steps, (success, difficulty, None), None) for name, steps, success, difficulty in rows], SCHEMA)


GOOD = [step(1, "a", '{"x": 1}', "fine"), step(2, "b", '{"x": 2}', "fine"), step(3, "c", '{"x": 3}', "fine"), step(4, "Finish", '{"final_answer": "Here is the list you asked for: found 3 results"}')]
BAD = [*GOOD[:3], step(4, "Finish", '{"final_answer": "Sorry, an error occurred, I am unable to do this"}')]


def outcome(parts):
    kept, log = parts
    return sorted(r.trajectory_id for r in kept.collect()), {r.trajectory_id: r.reject_reason for r in log.collect()}


def test_unknown_outcomes_stay(spark):
    rows = frame(spark, ("yes", GOOD, True, "easy"), ("no", GOOD, False, "easy"), ("unknown", GOOD, None, None))
    assert outcome(curation.loaded(rows, "toolbench")) == (["no", "unknown", "yes"], {})
    assert outcome(curation.loaded(rows, "toolbench", success=True)) == (["unknown", "yes"], {"no": "task_success"})
    assert outcome(curation.loaded(rows, "swebench", difficulty="easy")) == (["no", "yes"], {"unknown": "difficulty"})


def test_grader_must_agree(spark):
    rows = frame(spark, ("yes", GOOD, True, None), ("bad", BAD, True, None), ("no", GOOD, False, None), ("unknown", GOOD, None, None))
    assert outcome(curation.loaded(rows, "toolbench", aligned=True)) == (["yes"], dict.fromkeys(("bad", "no", "unknown"), "grader_aligned"))


@pytest.mark.parametrize("benchmark, kept", [("toolbench", ["four", "one"]), ("swebench", ["four"])])
def test_bounds_of_a_benchmark(spark, benchmark, kept):
    rows = frame(spark, ("four", GOOD, True, None), ("one", GOOD[:1], True, None), ("none", [], True, None))
    names, log = outcome(curation.loaded(rows, benchmark))
    assert names == kept and log["none"] == "too_few_steps:0"


def test_tools_need_substitutes_in_every_part(spark):
    rows = frame(spark, ("all", GOOD, True, None), ("none", [step(i, "z", "{}") for i in range(1, 5)], True, None))
    known = spark.createDataFrame([("a", "a2"), ("b", "b2"), ("c", "c2"), ("c", "c3")], "tool string, substitute string")
    assert outcome(curation.loaded(rows, "toolbench", substitutes=known)) == (["all"], {"none": "tool_diversity"})
    assert outcome(curation.loaded(rows, "toolbench", coverage=True))[0] == ["all"]


def test_sample_is_the_same_in_any_partitions(spark):
    rows = frame(spark, *[(f"t{i}", GOOD, None, None) for i in range(50)])
    one, other = (outcome(curation.loaded(r, "toolbench", 7))[0] for r in (rows.coalesce(1), rows.repartition(9)))
    assert one == other and len(one) == 7


def test_closure_of_a_long_chain(spark):
    edges = spark.range(2, 300).select(F.lit("t").alias("trajectory_id"), F.col("id").alias("step_index"), (F.col("id") - 1).alias("source_step"))
    edges.createOrReplaceTempView("_chain")
    got = typing.closure_recursive(spark, "_chain")
    assert got.count() == 298 * 299 // 2
    assert sum(len(r.ancestors) for r in typing.closure(edges).collect()) == 298 * 299 // 2


def test_units_with_headers(spark, tmp_path):
    """A header for each benchmark, null as 'unknown'; the records come back."""
    from trailmetric.sources import export_units, read_units

    units = spark.createDataFrame([("u1", "gaia"), ("u2", "gaia"), ("u3", None)], "unit_id string, benchmark string")
    export_units(units, str(tmp_path / "a"))
    heads = {r.benchmark: (r.unit_count, r.total_units, r.format_version) for r in spark.read.json(str(tmp_path / "a/metadata")).collect()}
    assert heads == {"gaia": (2, 3, "1.0"), "unknown": (1, 3, "1.0")}
    assert sorted(map(tuple, read_units(spark, str(tmp_path / "a"), "unit_id string, benchmark string").collect())) == [("u1", "gaia"), ("u2", "gaia"), ("u3", "unknown")]
    export_units(units.limit(0), str(tmp_path / "b"), by=None)
    head = spark.read.json(str(tmp_path / "b/metadata")).first()
    assert head.total_units == 0 and head.exported_at.endswith("Z")
