"""Candidates, selection and records of generated perturbations, and value mutations, on small frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trailmetric.operators import generation, perturbation, structural, units
from trailmetric.plans import units as fixtures

DATA = "/root/testdata/sf0.01"


def every(spark, f, kind, value):
    """(value, method) of a mutation by 12 keys."""
    rows = spark.range(12).select(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.col("id").cast("string").alias("key"))
    return {tuple(r.m) for r in rows.select(f(F.col("kind"), F.col("value"), 1, F.col("key")).alias("m")).collect()}


@pytest.mark.parametrize(
    "f, kind, value, values",
    [
        (perturbation.wrong_value, "integer", "100", {"80", "120"}),
        (perturbation.wrong_value, "integer", "-3", {"-5", "-1"}),
        (perturbation.wrong_value, "string", "bert-base", {"gpt-base"}),
        (perturbation.wrong_value, "string", "ENABLED", {"ENABLED"}),  # the sign is found in lower case and replaced as it is written
        (perturbation.off_by, "integer", "0", {"0", "1"}),
        (perturbation.off_by, "float", "1.5", {"1.4", "1.6", "0.5", "2.5"}),
        (perturbation.threshold_shift, "integer", "7", {"70", "0"}),
        (perturbation.threshold_shift, "integer", "-25", {"-250", "-2"}),
        (perturbation.threshold_shift, "integer", "0", {"10"}),
        (perturbation.threshold_shift, "float", "0.5", {"5.0", "0.05"}),
        (perturbation.threshold_shift, "float", "0", {"1.0"}),
        (perturbation.wrong_parameter, "boolean", "True", {"false"}),
        (perturbation.wrong_parameter, "string", "ab", {"abab"}),
        (perturbation.typo_in_id, "filepath", "/a.b/wait.py", {"/a_b/wait.py"}),
        (perturbation.typo_in_id, "identifier", "user_199", {"user_200"}),
        (perturbation.typo_in_id, "entity_name", "ab", {"ba"}),
    ],
)
def test_value_types(spark, f, kind, value, values):
    got = {v for v, _ in every(spark, f, kind, value)}
    assert got <= values and (len(values) == 1 or len(got) > 1)


def test_usual_wrong_numbers(spark):
    got = {v for v, _ in every(spark, perturbation.wrong_parameter, "integer", "7")}
    assert got <= {"0", "1", "-1", "100", "1000", "14", "3"} and len(got) > 2


def test_slots_by_name(spark):
    rows = spark.createDataFrame([("a.top_k", "integer"), ("a.name", "integer"), ("a.query", "string"), ("limit", "string"), ("size", None)], "s string, t string")
    got = rows.select(perturbation.is_threshold(F.col("s"), F.col("t")).alias("a"), perturbation.is_query(F.col("s"), F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (True, False), (False, True), (False, False), (False, False)]  # "n" in "name" counts


@pytest.mark.parametrize("count, want", [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (5, (3, 1, 1)), (10, (5, 2, 3))])
def test_class_targets(count, want):
    targets = generation.class_targets(count)
    assert tuple(targets[c] for c in ("fine_grained", "placebo", "coarse_grained")) == want


def plain_choice(candidates, count):
    targets, counts, used, taken = generation.class_targets(count), dict.fromkeys(generation.CLASSES, 0), set(), []
    for i, (step, classes) in enumerate(candidates):
        if len(taken) >= count:
            break
        wanted = next((c for c in generation.CLASSES if c in classes and counts[c] < targets[c]), None)
        if wanted is None or (step in used and counts[wanted] < targets[wanted] - 1):
            continue
        taken.append((i, wanted))
        used.add(step)
        counts[wanted] += 1
    return taken


def test_selection_against_a_loop(spark):
    rnd, rows = random.Random(4), []
    for t in range(60):
        rows.append((t, [(rnd.randint(0, 4), str(i), "x", "v", "early", ["f"], rnd.sample(generation.CLASSES, rnd.randint(1, 3)), 1.0) for i in range(rnd.randint(0, 12))]))
    frame = spark.createDataFrame(rows, f"t int, candidates array<{generation.CANDIDATE}>")
    for count in (1, 3, 6):
        got = frame.select("t", generation.chosen(F.col("candidates"), count).alias("x")).collect()
        for r in got:
            want = plain_choice([(c[0], c[6]) for c in rows[r.t][1]], count)
            assert [(int(x.candidate.slot), x["class"]) for x in r.x] == want


def test_records_change_their_target_and_can_be_undone(spark):
    own = fixtures.trajectories(spark, DATA)
    made = generation.generated(own, fixtures.slots(own), 6, seed=3)
    back = units.reverted(*[F.col(c) for c in ("perturbed_steps", "target_step_index", "target_slot", "original_value", "perturbed_value", "undo")])
    rows = made.withColumn("back", back).collect()
    assert len(rows) > 150 and {r.perturbation_class for r in rows} == set(generation.CLASSES)
    assert len({(r.trajectory_id, r.place) for r in rows}) == len(rows)
    kinds = {r.perturbation_type for r in rows}
    assert kinds >= {"wrong_value", "threshold_shift", "query_drift", "wrong_parameter", "formatting", *structural.COARSE}
    for r in rows:
        assert r.back == r.steps and r.perturbed_steps != r.steps
        for s in r.perturbed_steps:
            if s.tool_arguments:
                json.loads(s.tool_arguments)
        if r.perturbation_class != "coarse_grained":
            assert [a.step_index for a, b in zip(r.steps, r.perturbed_steps, strict=True) if a != b] == [r.target_step_index]
    again = generation.generated(own.repartition(5), fixtures.slots(own), 6, seed=3)
    assert sorted(r.perturbation_id for r in again.select("perturbation_id").collect()) == sorted(r.perturbation_id for r in rows)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Find the error. FINISH now", "Locate the issue. COMPLETE now"), ("Finish: nothing", None), ("Tool Input: put input", "Tool Input: place provide"), ("éfind", None), (None, None), ("", None),
        ("checks check", "checks verify"), ("a\nfind\n", "a\nlocate\n"),
    ],
)
def test_synonyms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(perturbation.with_synonyms(F.col("t")).alias("x")).first().x == want
