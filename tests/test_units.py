"""Perturbations of trajectories, their inverse, checks and evaluation units, on small frames."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailmetric.functions import json_text
from trailmetric.operators import record_checks, structural, units

STEP = structural.STEP
NAMES = ("step_index", "step_role", "raw_text", "tool_name", "tool_arguments", "observation", "is_terminal_step", "produces_final_answer", "has_artifacts", "critical_path_score")


def step(i, role="reasoning", text="a text that is long enough", tool=None, args=None, end=False, made=False):
    return (i, role, text, tool, args, None, end, end, made, 0.5)


def trajectories(spark, *lists):
    return spark.createDataFrame([(f"t{i}", "gaia", steps) for i, steps in enumerate(lists)], f"trajectory_id string, benchmark string, steps array<{STEP}>")


@pytest.mark.parametrize(
    "document, path, value, at, after",
    [
        ('{"a": 1, "b" : {"c":[10, {"d":"x\\"y}"}], "a":7}, "e":"q,:"}', "b.c[1].d", '"n"', '"x\\"y}"', '{"a": 1, "b" : {"c":[10, {"d":"n"}], "a":7}, "e":"q,:"}'),
        ('{"a": 1, "b" : {"a":7}}', "a", "5", "1", '{"a": 5, "b" : {"a":7}}'),
        ('{"k": "\\\\", "a": null}', "a", "true", "null", '{"k": "\\\\", "a": true}'),
        ('[1, [2,3] , 4]', "[1][0]", "9", "2", "[1, [9,3] , 4]"),
        ('{"a": 1}', "b", "5", None, '{"a": 1}'),
        ('{"a": {"b": 1}}', "a.b.c", "5", None, '{"a": {"b": 1}}'),
        ("{}", "a", "5", None, "{}"),
        ('{"é😀": "ü😀", "z": [ ]}', "z", "[1]", "[ ]", '{"é😀": "ü😀", "z": [1]}'),
    ],
)
def test_json_places(spark, document, path, value, at, after):
    d = spark.createDataFrame([(document, path, value)], "d string, p string, v string")
    parts = json_text.path_parts(F.col("p"))
    r = d.select(json_text.value_at(F.col("d"), parts).alias("at"), json_text.with_value(F.col("d"), parts, F.col("v")).alias("after")).first()
    assert (r.at, r.after) == (at, after)
    if at is not None:
        json.loads(r.after)


def test_json_of_many_escapes(spark):
    text = json.dumps({"code": 'line "x"\n\\' * 20_000, "n": 1})
    r = spark.createDataFrame([(text,)], "d string").select(json_text.with_value(F.col("d"), F.array(F.lit("n")), F.lit("22")).alias("x"), json_text.plain(json_text.value_at(F.col("d"), F.array(F.lit("code")))).alias("code")).first()
    assert r.x == text[:-2] + "22}" and r.code == json.loads(text)["code"]


def test_quoted_is_json(spark):
    text = 'a"b\\c\nd\te\r/é'
    r = spark.createDataFrame([(text,)], "t string").select(json_text.quoted(F.col("t")).alias("q"), json_text.plain(json_text.quoted(F.col("t"))).alias("p")).first()
    assert json.loads(r.q) == text == r.p


@pytest.mark.parametrize(
    "plan, want",
    [
        ("Find the bug and fix it. Then rest", "Find the bug. Then rest"),
        ("first\nRead and write", "first\nRead."),
        ("one\nand two. three", "one. three"),
        ("Brand new: investigate the error", "Brand new: patch the error"),
        ("Verify the sum, then confirm", "Verify the sum, then use"),
        ("Look it up", "Quickly look it up"),
        ("quick search", None),
        ("Go on", "Take a simple approach: Go on"),
        ("a simple way", None),
        ("all x as well as y.", "all x."),
        ("", "Take a simple approach: "),
        (None, None),
    ],
)
def test_inferior_plan(spark, plan, want):
    assert spark.createDataFrame([(plan,)], "p string").select(structural.inferior_plan(F.col("p")).alias("x")).first().x == want


def test_long_plan_takes_one_pass(spark):
    plan = "word handle " * 200_000 + "\n" * 50_000
    got = spark.createDataFrame([(plan,)], "p string").select(structural.inferior_plan(F.col("p")).alias("x")).first().x
    assert got == "Take a simple approach: " + plan


def test_false_terminal_takes_eligible_steps_only(spark):
    eligible = step(4, "observation", made=True)
    steps = [step(0, "planning"), step(1, text="it goes on..."), step(2, text="short"), step(3, text="a long text with a comma,"), eligible, step(5, end=True)]
    for seed in range(5):
        r = trajectories(spark, steps).select(structural.false_terminal(F.col("steps"), seed, F.col("trajectory_id")).alias("m")).first().m
        assert (r.record.target_step_index, r.record.target_slot, r.record.original_value, r.record.perturbed_value) == (4, "is_terminal_step", "false", "true")
        assert [s.is_terminal_step for s in r.steps] == [False] * 4 + [True, True] and r.steps[4].raw_text == eligible[2]
    assert trajectories(spark, steps[:4]).select(structural.false_terminal(F.col("steps"), 1, F.col("trajectory_id")).alias("m")).first().m is None


def test_premature_termination_bounds(spark):
    whole = [step(i, "observation" if i != 3 else "decision", end=i == 5) for i in range(6)]
    short, late = whole[:2], [step(0), step(1, end=True), step(2)]
    no_results = [step(i, "observation") for i in range(5)]
    got = trajectories(spark, whole, short, late, no_results, []).select("trajectory_id", structural.premature_termination(F.col("steps"), 3, F.col("trajectory_id")).alias("m")).collect()
    by = {r.trajectory_id: r.m for r in got}
    assert by["t1"] is None and by["t2"] is None and by["t4"] is None
    assert by["t0"].record.target_step_index == 3 and len(by["t0"].steps) == 4 and (by["t0"].record.original_value, by["t0"].record.perturbed_value) == ("6", "4")
    assert by["t0"].steps[-1].is_terminal_step and by["t0"].steps[-1].produces_final_answer
    assert 1 <= by["t3"].record.target_step_index <= 3


@pytest.mark.parametrize(
    "name, family",
    [("bash", "code_execution"), ("insert", "database"), ("read_file_lines", "file_operations"), ("weather_api_call", "api_calls"), ("view", "file_operations"), ("sqlite", "database"), ("prefetching", "web_search"), ("zzz", None)],
)
def test_tool_family(spark, name, family):
    assert spark.createDataFrame([(name,)], "n string").select(structural.tool_family(F.col("n")).alias("f")).first().f == family


def test_wrong_tool_comes_from_a_family_that_may_stand_for_its_own(spark):
    steps = [step(0, "planning"), step(1, "tool_call", tool="zzz"), step(2, "tool_call", "use Bash here, Bash", tool="Bash")]
    frame = trajectories(spark, steps)
    allowed = {t for f in structural.OTHER_FAMILIES["code_execution"] for t in structural.TOOL_FAMILIES[f]}
    for seed in range(6):
        m = frame.select(structural.wrong_tool_family(F.col("steps"), seed, F.col("trajectory_id")).alias("m")).first().m
        assert m.record.target_step_index == 2 and m.record.perturbed_value in allowed
        assert m.steps[2].raw_text == f"use {m.record.perturbed_value} here, {m.record.perturbed_value}" and m.steps[1].tool_name == "zzz"


def test_race_follows_weights(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    weights = {"a": 0.6, "b": 0.3, "c": 0.1, "d": 0.0}
    got = rows.select(structural.raced(weights, 1, F.col("k")).alias("o")).collect()
    assert all(sorted(r.o) == ["a", "b", "c"] for r in got)
    first, second = Counter(r.o[0] for r in got), Counter(r.o[1] for r in got if r.o[0] == "a")
    assert abs(first["a"] / 20_000 - 0.6) < 0.015 and abs(first["c"] / 20_000 - 0.1) < 0.01
    assert abs(second["b"] / sum(second.values()) - 0.75) < 0.02  # without repetition: 0.3 of the 0.4 that are left


def test_coarse_falls_through_to_the_next_type(spark):
    only_plan = [step(0, "planning", "Go on"), step(1, "observation", "x")]
    none = [step(0, "observation", "x")]
    rows = structural.coarse(trajectories(spark, only_plan, none, []), seed=5, weights={"false_terminal": 0.9, "premature_termination": 0.05, "wrong_tool_family": 0.04, "wrong_plan": 0.01}).collect()
    assert [(r.trajectory_id, r.perturbation_type, r.perturbed_value) for r in rows] == [("t0", "wrong_plan", "Take a simple approach: Go on")]
    assert structural.coarse(trajectories(spark, only_plan), weights={"wrong_plan": 0.0, "false_terminal": 1.0}).count() == 0


def test_every_coarse_record_can_be_undone(spark):
    long = [step(0, "planning", "Find and fix"), step(1, "tool_call", "run get now", tool="run"), step(2, "reasoning"), step(3, "extraction", made=True), step(4, "tool_call", "x", tool="web_search"), step(5, end=True)]
    frame = trajectories(spark, *[long] * 40)
    made = structural.coarse(frame, seed=9)
    back = made.withColumn("b", units.reverted(*[F.col(c) for c in ("perturbed_steps", "target_step_index", "target_slot", "original_value", "perturbed_value", "undo")])).collect()
    assert {r.perturbation_type for r in back} == set(structural.COARSE)
    assert all(r.b == r.steps and r.perturbed_steps != r.steps for r in back)
    assert len({r.perturbation_id for r in back}) == 40


def test_unit_of_a_deletion_and_an_insertion(spark):
    steps = [step(0), step(1, "tool_call", tool="bash", args='{"a": {"b": [1, 2]}}'), step(2, "extraction", "gone"), step(3, end=True)]
    frame = trajectories(spark, steps)
    schema = "perturbation_id string, source_trajectory_id string, perturbation_index int, perturbation_class string, perturbation_family string, perturbation_type string, target_step_index int, target_slot string, original_value string, perturbed_value string"
    as_json = lambda s: json.dumps(dict(zip(NAMES, s, strict=True)))
    rows = [
        ("p0", "gaia_1", 0, "coarse_grained", "structural", "x", 2, "step", as_json(steps[2]), None),
        ("p1", "gaia_1", 1, "coarse_grained", "structural", "x", 9, "step", None, as_json(step(9))),
        ("p2", "gaia_1", 2, "fine_grained", "parameter", "x", 1, "tool_arguments.a.b[1]", "2", "77"),
        ("p3", "gaia_1", 3, "fine_grained", "parameter", "x", 1, "step", "no json", None),
        ("p4", None, 4, "fine_grained", "parameter", "x", 1, "raw_text", "a", "b"),
        ("p5", "gaia_1", 5, "coarse_grained", "terminal_flag", "premature_termination", 1, "trajectory_length", "4", "2"),
    ]
    records = spark.createDataFrame(rows, schema).crossJoin(frame.select("benchmark", "steps"))
    changed = (
        F.when(F.col("perturbation_id") == "p0", structural.without_step(F.col("steps"), F.lit(2)))
        .when(F.col("perturbation_id") == "p1", F.concat("steps", F.array(F.get("steps", 0).withField("step_index", F.lit(9)))))
        .when(F.col("perturbation_id") == "p2", structural.with_slot(F.col("steps"), F.lit(1), F.col("target_slot"), F.col("perturbed_value")))
        .otherwise(F.col("steps"))
    )
    made = units.assembled(records.withColumns({"perturbed_steps": changed, "undo": F.lit(None).cast(structural.UNDO)}))
    by = {r.perturbation_id: r for r in made.collect()}
    for p in ("p0", "p1", "p2"):
        assert by[p].error is None and [tuple(b.step) for b in by[p].baseline] == steps, p
    assert by["p2"].perturbed[1].step.tool_arguments == '{"a": {"b": [1, 77]}}'
    assert [b.display_step_index for b in by["p0"].perturbed] == [1, 2, 3] and [b.display_step_index for b in by["p0"].baseline] == [0, 1, 2, 3]
    assert by["p0"].baseline[2].canonical_step_id == "gaia_1::step::2" and by["p0"].evaluation_unit_id == "eval::gaia_1::000" and by["p0"].perturbed_variant_id == "gaia_1::pert::000"
    assert (by["p0"].derived_cache.baseline_num_steps, by["p0"].derived_cache.perturbed_num_steps) == (4, 3) and by["p0"].replay_tier == 3
    b = by["p0"].blinding
    assert {b.trajectory_a_variant_id, b.trajectory_b_variant_id} == {"gaia_1::base", "gaia_1::pert::000"} and b.is_a_baseline == (b.trajectory_a_variant_id == "gaia_1::base") != b.is_a_perturbed
    assert (by["p3"].error, by["p4"].error, by["p5"].error) == ("unreadable step", "no source trajectory", "removed steps unknown") and by["p3"].baseline is None


def record(**changes):
    base = {"perturbation_id": "p", "original_trajectory_id": "t", "generation_timestamp": "now", "perturbation_class": "fine_grained", "perturbation_family": "parameter", "perturbation_type": "query_drift", "target_step_index": 1, "target_slot": "raw_text", "mutation_method": "m", "original_value": "5", "perturbed_value": "7", "critical_path_score": 0.9, "affects_final_answer": True, "recoverable_if_wrong": False}
    return {**base, "perturbed_steps": [step(0), step(1)], **changes}


@pytest.mark.parametrize(
    "changes, status, failed, impact",
    [
        ({}, "valid", [], 3),
        ({"perturbed_value": " 5 "}, "invalid", ["diff_content_changed"], 3),
        ({"original_value": None, "perturbed_value": None}, "invalid", ["diff_content_changed"], 3),
        ({"perturbation_id": " "}, "invalid", ["schema_required_fields"], 3),
        ({"target_step_index": -1}, "invalid", ["schema_target_step_index"], 3),
        ({"target_step_index": None}, "invalid", ["schema_required_fields", "schema_target_step_index"], 3),
        ({"perturbation_family": "structural"}, "borderline", ["class_family_combination", "family_type_combination"], 3),
        ({"perturbation_type": "wrong_value"}, "valid", ["family_type_combination"], 3),
        ({"perturbation_family": "tool_selection", "perturbation_type": "wrong_tool_family"}, "borderline", ["tool_selection_class_rule"], 3),
        ({"perturbation_type": "odd"}, "invalid", ["schema_perturbation_type", "class_family_enum_parse"], 3),
        ({"perturbed_steps": []}, "borderline", ["coherence_has_steps"], 3),
        ({"perturbed_steps": [step(0), step(2)]}, "valid", ["coherence_sequential_indices"], 3),
        ({"perturbed_steps": [step(0, "tool_call"), step(1, text=" \n")]}, "valid", ["coherence_tool_names", "coherence_no_empty"], 3),
        ({"perturbed_steps": [step(0), step(1, None)]}, "borderline", ["coherence_step_fields"], 3),
        ({"perturbation_class": "placebo", "perturbation_type": "paraphrase", "original_value": "read 5 at /a/b", "perturbed_value": "grep 6 at /a/c"}, "valid", ["diff_placebo_numbers", "diff_placebo_tools", "diff_placebo_filepaths"], 0),
        ({"critical_path_score": None, "affects_final_answer": None, "recoverable_if_wrong": None}, "valid", [], 1),
    ],
)
def test_record_checks(spark, changes, status, failed, impact):
    row = record(**changes)
    schema = "perturbation_id string, original_trajectory_id string, generation_timestamp string, perturbation_class string, perturbation_family string, perturbation_type string, target_step_index int, target_slot string, mutation_method string, original_value string, perturbed_value string, critical_path_score double, affects_final_answer boolean, recoverable_if_wrong boolean, perturbed_steps array<" + STEP + ">"
    got = record_checks.checked(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert (got.generation_status, got.checks_failed, got.expected_impact) == (status, failed, impact)
    assert set(got.warnings) <= set(got.checks_failed) and not set(got.checks_passed) & set(got.checks_failed)


def test_step_changes(spark):
    a, b = [step(0), step(1), step(2)], [step(0), step(1, text="other", tool="x"), step(3)]
    frame = spark.createDataFrame([(a, b), (a, a), (a, [step(0), step(1, text="other"), step(2)])], f"a array<{STEP}>, b array<{STEP}>")
    changes = record_checks.step_changes(F.col("a"), F.col("b"))
    got = frame.select(changes.alias("c"), record_checks.only_target(changes, F.lit(1), "raw_text").alias("only")).collect()
    assert [tuple(c) for c in got[0].c] == [("changed", 1, ["raw_text", "tool_name"]), ("removed", 2, []), ("added", 3, [])]
    assert got[1].c == [] and [r.only for r in got] == [False, False, True]


def test_substitutes_of_a_catalogue(spark):
    catalogue = spark.createDataFrame([(f"tool{i}", f"f{i % 7 if i % 3 else 0}") for i in range(300)] + [("lonely", "z"), ("lonely", "z"), (None, "z")], "tool string, family string")
    family = {r.tool: r.family for r in catalogue.collect()}
    asked = spark.createDataFrame([(str(i), f"tool{i % 300}") for i in range(900)] + [("a", "lonely"), ("b", "unknown")], "key string, tool string")
    near = structural.substituted(asked, catalogue, 3, near=True).collect()
    anti = structural.substituted(asked, catalogue, 3, near=False).collect()
    assert len(near) == len(anti) == 902
    for r in near:
        assert (r.substitute is None) == (r.tool in ("lonely", "unknown")) and (r.substitute is None or (family[r.substitute] == family[r.tool] and r.substitute != r.tool))
    assert all((r.substitute is None) == (r.tool == "unknown") and (r.substitute is None or family[r.substitute] != family[r.tool]) for r in anti)
    assert len({r.substitute for r in anti}) > 200
    one = spark.createDataFrame([("x", "only")], "tool string, family string")
    assert structural.substituted(spark.createDataFrame([("k", "x")], "key string, tool string"), one, 1, near=False).first().substitute is None


def test_near_neighbours(spark):
    got = {r.n: r.x for r in spark.createDataFrame([("grep",), ("bash",), ("my_search",), ("qqq",)], "n string").select("n", structural.near_neighbours(F.col("n")).alias("x")).collect()}
    assert "ripgrep" in got["grep"] and "grep" not in got["grep"] and got["bash"] == sorted({"run", "exec", "execute", "sh", "shell", "run_command", "execute_command"}) and "web_search" in got["my_search"] and got["qqq"] == []
