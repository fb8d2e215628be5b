import json

import pytest
from pyspark.sql import functions as F

from trailmetric.operators import curation, gates, labels, metrics, perturbation, relational, sampling, typing
from trailmetric.sources import parsers, schemas, status
from trailmetric.sources.store import Store


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(relational.upsert(old, new, ["k"]), "k") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(relational.upsert(old, new, ["k"], keep="old"), "k") == [(1, "a"), (2, "b"), (3, "C")]
    left = relational.pending(new, old, ["k"])
    assert rows(left) == [(3, "C")] and relational.pending(new, old, ["k"], force=True).count() == 2
    with pytest.raises(ValueError):
        relational.insert_new(old, new, ["k"])


def test_keep_first_ignores_white_space(spark):
    frame = spark.createDataFrame([(1, " a  b"), (2, "a b "), (3, None), (4, "")], "id int, t string")
    kept, gone = relational.keep_first(frame, F.col("t"), [F.col("id")], "id")
    assert rows(kept.select("id"), "id") == [(1,), (3,)]
    assert rows(gone.select("id", "duplicate_of"), "id") == [(2, 1), (4, 3)]


def test_pages_are_disjoint(spark):
    frame = spark.range(10)
    a, b = (relational.page(frame, [F.desc("id")], s, 4) for s in (0, 4))
    assert not set(rows(a)) & set(rows(b)) and a.count() == b.count() == 4


def test_vote_tie_goes_to_first_seen(spark):
    frame = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("w", "x", 3)], "u string, v string, seq int")
    got = rows(labels.majority(frame, "u", "v", "seq", "m"), "u")
    assert got == [("u", "b", 0.5), ("w", "x", 1.0)]


def test_runs_break_on_null(spark):
    frame = spark.createDataFrame([("p", i, v) for i, v in enumerate(["x", "x", None, "x", "x", "x"])], "a string, t int, v string")
    assert rows(labels.runs(frame, "a", "v", [F.col("t")], threshold=3)) == [("p", 3, True)]
    assert rows(labels.flagged_runs(frame, "a", "v", [F.col("t")], threshold=2)) == [("p", 0, 1, "x", 2), ("p", 3, 5, "x", 2)]


def test_samples_fill_quotas_and_repeat(spark):
    frame = spark.range(300).select(F.col("id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("c"))
    quotas = sampling.split_quota(100, {"a": 0.5, "b": 0.5}, "b")
    one = sampling.with_fill(frame, "c", "id", quotas, ["a", "b"])
    two = sampling.with_fill(frame.repartition(7), "c", "id", quotas, ["a", "b"])
    assert rows(one, "id") == rows(two, "id") and one.count() == 100 and one.filter("c = 'a'").count() == 30
    shown = sampling.overlap(spark.range(40).select("id"), "id", ["x", "y", "z"], to_all=5, paired=10)
    assert shown.count() == 5 * 3 + 10 * 2 + 25
    weighted = sampling.weighted_without_replacement(frame, F.when(F.col("c") == "a", 100.0).otherwise(0.01), "id", 25)
    assert weighted.filter("c = 'a'").count() >= 23
    minimum = sampling.with_minimums(frame, "c", {"a": 10, "b": 5}, 40, "id")
    assert minimum.count() == 40 and minimum.filter("c = 'a'").count() >= 10
    dealt = sampling.dealt(frame.filter("c = 'a'"), spark.range(5).withColumnRenamed("id", "t"), "id", "t", 3)
    assert dealt.groupBy("t").count().filter("count <> 3").count() == 0


def test_fair_shares_and_caps(spark):
    frame = spark.range(400).select(F.col("id").alias("trajectory_id"), F.lit("g").alias("benchmark"), F.when(F.col("id") < 350, "big").otherwise("small").alias("domain"))
    got = sampling.fair_shares(frame, "benchmark", "domain", {"g": 100})
    assert got.count() == 150
    assert sampling.domain_caps(frame, 100, {"big": 0.3}).filter("domain = 'big'").count() <= 30


def test_greedy_uses_a_step_twice_only_for_the_last_place(spark):
    rows_ = [("t", f"c{i}", s, "a", 1 - i / 10) for i, s in enumerate([1, 1, 2])]
    frame = spark.createDataFrame(rows_, "trajectory_id string, candidate_id string, step_index int, perturbation_class string, score double")
    got = rows(sampling.greedy_select(frame, {"a": 2}).select("candidate_id"), "candidate_id")
    assert got == [("c0",), ("c1",)]


def test_batches_survive_a_failure(spark):
    frame = spark.createDataFrame([(i, None, None) for i in range(6)], "id int, status string, error string").coalesce(1)

    def call(part):
        if 2 in set(part["id"]):
            raise RuntimeError("no")
        return part

    got = rows(sampling.in_batches(frame, call, frame.schema, size=2), "id")
    assert [s for _, s, _ in got] == ["success", "success", "failed", "failed", "success", "success"]


TRAJECTORY = "trajectory_id string, steps array<struct<step_id string, step_number int, step_type string, content string, tool_name string, tool_input string, tool_output string>>, ground_truth struct<expected_answer string, task_success boolean>"


def trajectory(spark, steps, answer="fine", success=True):
    made = [(f"s{i}", i + 1, *s) for i, s in enumerate(steps)]
    return spark.createDataFrame([("t", made, (answer, success))], TRAJECTORY)


GOOD = [("reasoning", "think about it", None, None, None), ("tool_execution", "calling", "api", '{"a": 1}', "data"), ("tool_execution", "finishing", "Finish", '{"return_type": "give_answer", "final_answer": "fine"}', None)]


@pytest.mark.parametrize(
    "steps,benchmark,want",
    [
        (GOOD, "toolbench", None),
        ([*GOOD[:2]], "toolbench", "toolbench_strict:final_not_finish"),
        ([("tool_execution", "calling", "api", '{"a": 1}', "403")] * 3 + GOOD, "swebench", None),
        ([("tool_execution", "calling", "api", '{"a": 1}', "403")] * 4 + GOOD, "swebench", "http_error_rate:0.57>0.5"),
        ([("reasoning", "Thought: None", None, None, None)] * 2 + GOOD, "swebench", "thought_none_count:2>=2"),
        ([("reasoning", "Thought: None", None, None, "500")] + GOOD, "swebench", "combined_errors:http_errors+thought_none"),
        ([("tool_execution", "calling", "api", None, None)] * 3, "gaia", "missing_tool_input_rate:1.00>0.5"),
        ([("reasoning", "a", None, None, None)] + GOOD, "swebench", "empty_content_rate:0.25>0.2"),
    ],
)
def test_first_failing_rule(spark, steps, benchmark, want):
    assert curation.reject_reason(trajectory(spark, steps), benchmark, enabled=True).first().reject_reason == want


def test_filters_are_off_by_default_and_log(spark):
    frame = trajectory(spark, [])
    assert curation.reject_reason(frame, "gaia").first().reject_reason is None
    kept, log = curation.split_rejected(curation.reject_reason(trajectory(spark, GOOD, None, None), "gaia", enabled=True))
    assert kept.count() == 0 and rows(log) == [("t", "null_outcome")]
    assert rows(curation.step_count_reason(frame, 1, 5).select("reject_reason")) == [("too_few_steps:0<1",)]


def test_cleaning(spark):
    steps = [("reasoning", "ok", None, None, None), ("tool_execution", "no tool here", None, None, None), ("reasoning", "Thought: None", None, None, None)]
    row = curation.with_clean_steps(trajectory(spark, steps)).first()
    assert [(s.step_number, s.step_type) for s in row.steps] == [(1, "reasoning")] and row.steps_removed == 2


def test_parameters_everywhere(spark):
    call, none = ("tool_execution", "calling", "api", '{"a": 1}', "x"), ("reasoning", "thinking", None, None, None)
    covered = lambda *steps: trajectory(spark, list(steps)).filter(curation.parameters_everywhere(F.col("steps"))).count() == 1
    assert covered(call, call, call) and covered(call, call) and not covered(call) and not covered(none, none, call)
    assert covered(none, call, none, none, none, call, none) is False and covered(none, call, call, call, none, none, call)
    assert not covered(call, none, GOOD[0])


def test_gates(spark):
    frame = spark.createDataFrame([(1, "x_old", "a1", "a1", "placebo"), (2, "fine", "b", "c 2", "placebo"), (3, '{"a"', "d", "d", "fine_grained")], "id int, v string, o string, p string, k string")
    assert gates.no_synthetic_markers(frame, "id", "v").first().status == "fail"
    assert gates.json_validity(frame, "id", "v", over_checked=True).first().value == 0.0
    row = gates.placebo_semantics(frame, "id", "o", "p", "k").first()
    assert (row.status, row.violations, row.examples) == ("warn", 1, ["2"])
    assert gates.meaningful_change(frame, "id", "o", "p", "k").first().examples == ["3"]
    assert gates.unique_ids(frame.union(frame.limit(1)), "id").first().status == "fail"
    assert gates.unique_ids(frame, "id").first().status == "pass"
    assert gates.class_validity(frame.filter("id > 9").withColumn("m", F.lit(1)), "id", "m").first().status == "skip"

    def broken():
        raise RuntimeError("boom")

    report = gates.run_phase("p", [lambda: gates.trajectory_count(frame, "id"), broken])
    assert dict(report.select("gate", "status").collect()) == {"trajectory_count": "fail", "broken": "fail"}
    with pytest.raises(KeyError):
        gates.gate("none")


def test_prompt_gates(spark):
    frame = spark.createDataFrame([("good", "planning tool_selection parameter data_reference other"), ("bad", "Find the error in the perturbed trajectory")], "id string, p string")
    got = {r.gate: r.examples for r in gates.prompt_gates(frame, "id", "p").collect()}
    assert got["no_priming"] == ["bad"] and got["no_blinding_leak"] == ["bad"] and got["vocabulary"] == ["bad"] and got["neutrality"] == []


STEPS = "trajectory_id string, step_index int, raw_text string, tool_name string, tool_arguments string, observation string, step_type string, benchmark string"


def typed_rows(spark, *steps, benchmark="swebench"):
    return spark.createDataFrame([("t", i + 1, *s, "x", benchmark) for i, s in enumerate(steps)], STEPS)


def test_roles_and_operations(spark):
    frame = typed_rows(
        spark,
        ("I will look at it first", None, None, None),
        ("", "view_file", '{"path": "/testbed/src/main.py"}', "code"),
        ("there are (12) of them", None, None, None),
        ("", "str_replace_editor", '{"command": "create", "path": "/testbed/src/main.py"}', "ok"),
        ("edit after step 1", None, None, None),
        ("", "Finish", '{"return_type": "give_answer"}', None),
    )
    typed, edges = typing.typed(frame)
    got = {r.step_index: r for r in typed.collect()}
    assert [got[i].step_role for i in range(1, 7)] == ["planning", "tool_call", "extraction", "tool_call", "reasoning", "final_response"]
    assert [got[i].normalized_operation for i in (2, 4, 6)] == ["read", "write", "submit"]
    assert (got[3].extracted_value, got[3].value_type, got[3].source_step) == ("12", "integer", 2)
    assert got[4].produces_patch and got[6].produces_final_answer and not got[1].is_terminal_step
    pairs = {(r.step_index, r.source_step): r.evidence for r in edges.collect()}
    assert pairs[5, 1] == "textual:step_1" and pairs[4, 2].startswith("textual:file:main.py") or pairs[4, 2].startswith("file_path:")
    assert got[6].recoverable_if_wrong is False and 0 <= got[2].critical_path_score <= 1


def test_ungrounded_extraction_is_reasoning(spark):
    typed = typing.with_extraction(typed_rows(spark, ("the result is (5)", None, None, None)).withColumn("step_role", typing.step_role()))
    assert typed.first().step_role == "reasoning"


def test_closure_of_a_chain(spark):
    frame = spark.createDataFrame([("t", i, i - 1) for i in range(2, 200)], "trajectory_id string, step_index int, source_step int")
    got = {r.step_index: r.ancestors for r in typing.closure(frame).collect()}
    assert got[199] == list(range(1, 199)) and got[2] == [1]


def test_slots_and_paths(spark):
    document = json.dumps({"path": "/a/b.py", "opts": {"n": 3, "on": True, "list": [1, "x", None]}, "lat": 12.5})
    frame = spark.createDataFrame([("t", document), ("u", "not json")], "id string, tool_arguments string")
    got = {r.slot: r.value_type for r in typing.slots(frame, ["id"]).collect()}
    assert got == {"tool_arguments.path": "filepath", "tool_arguments.opts.n": "integer", "tool_arguments.opts.on": "boolean", "tool_arguments.opts.list[0]": "integer", "tool_arguments.opts.list[1]": "string", "tool_arguments.lat": "latitude"}
    assert typing.get_path(document, "opts.list[1]") == "x" and typing.get_path(document, "opts.none") is None
    edit = spark.createDataFrame([(document, "opts.n", "4"), (document, "nowhere", "1")], "d string, p string, v string")
    out = [r.o for r in typing.with_path_set(edit, "d", "p", "v", "o").collect()]
    assert json.loads(out[0])["opts"]["n"] == 4 and out[1] == document


@pytest.mark.parametrize("kind,value", [("integer", "10"), ("float", "2.5"), ("filepath", "src/a.py"), ("search_query", "two words"), ("string", "hello"), ("boolean", "true"), ("ipv4", "10.0.0.255"), ("identifier", "x"), ("date", "2024-01-31"), ("url", "https://a.b/c"), ("line_number", "30"), ("entity", "CamelName"), ("other", "word")])
def test_mutations_change_and_repeat(spark, kind, value):
    frame = spark.range(5).select("id", F.lit(kind).alias("k"), F.lit(value).alias("v"))
    made = frame.select("id", perturbation.mutated(F.col("k"), F.col("v"), 7, F.col("id")).alias("m"))
    one, two = rows(made.select("id", "m.value"), "id"), rows(made.repartition(3).select("id", "m.value"), "id")
    assert one == two and all(v is not None for _, v in one) and any(v != value for _, v in one)


def test_placebos(spark):
    frame = spark.createDataFrame([("Find the error. FINISH now", ), ("Finish: nothing", ), (None, )], "t string")
    assert [r.p for r in perturbation.placebo(frame, "t", "p").collect()] == ["Locate the issue. COMPLETE now", None, None]
    keys = perturbation.reordered(spark.createDataFrame([('{"b": 1, "a": 2}',), ("x",)], "d string"), "d", "o").collect()
    assert keys[0].o == '{"a": 2, "b": 1}' and keys[1].o is None


def test_quality_check(spark):
    frame = spark.createDataFrame(
        [("p1", "t", "5", "7", "fine_grained", "parameter", "threshold_shift", 0.9, True, False), ("p2", "t", "5", "5", "placebo", "parameter", "synonym", 0.5, None, None)],
        "perturbation_id string, original_trajectory_id string, original_value string, perturbed_value string, perturbation_class string, perturbation_family string, perturbation_type string, critical_path_score double, affects_final_answer boolean, recoverable_if_wrong boolean",
    )
    got = {r.perturbation_id: r for r in perturbation.quality_check(frame).collect()}
    assert got["p1"].qc_status == "valid" and got["p1"].derived_impact == 3
    assert got["p2"].qc_failed == ["no_change", "family_type"] and got["p2"].derived_impact == 0
    stats = {(r.kind, r.value): r.n for r in perturbation.qc_statistics(perturbation.quality_check(frame)).collect()}
    assert stats["impact", "1"] == 0 and stats["status", "invalid"] == 1


def test_conversations_parse(spark, tmp_path):
    item = {"id": "x", "conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "Thought: look\nAction: api_for_maps\nAction Input: {\"a\": 1}"}, {"from": "function", "value": "result"}, {"from": "assistant", "value": "Thought: done\nAction: Finish\nAction Input: {\"return_type\": \"give_answer\", \"final_answer\": \"yes\"}"}]}
    (tmp_path / "a.json").write_text(json.dumps([item]))
    from trailmetric.sources import read_json

    items = read_json(spark, str(tmp_path / "a.json"), schemas.CONVERSATION_ITEM)
    steps = {r.step_number: r for r in parsers.toolbench_steps(items).collect()}
    assert (steps[1].content, steps[1].tool_name, steps[1].tool_input, steps[1].tool_output) == ("look", "api_for_maps", '{"a": 1}', "result")
    assert steps[2].tool_output is None
    assert rows(parsers.conversation_outcome(items)) == [("x", True, "yes")]


def test_other_parsers(spark):
    swe = spark.createDataFrame([("i", None, '[{"role":"user","content":"u"},{"role":"assistant","content":"<function=edit><parameter=k>1</parameter><parameter=k>2</parameter></function>"}]', True, None, None)], schemas.SWE_ITEM)
    row = parsers.swe_steps(swe).first()
    assert (row.tool_name, row.tool_input) == ("edit", '{"k":"2"}')
    assert [r.r for r in spark.createDataFrame([("1. a\n2. b",), ("a\nb",), ("",)], "t string").select(parsers.numbered_steps(F.col("t")).alias("r")).collect()] == [["a", "b"], ["a", "b"], []]
    got = [r.r for r in spark.createDataFrame([('{"a": 1}',), ("5",), ("oops",), (None,)], "t string").select(parsers.tool_input(F.col("t")).alias("r")).collect()]
    assert got == ['{"a": 1}', '{"value":"5"}', '{"raw_input":"oops"}', "{}"]
    prompts = spark.createDataFrame([("[{'name': 'get_map_for_geo', 'description': 'draws'}, {'name': 'list_for_geo', 'description': ''}, {'name': 'Finish', 'description': 'x'}, {'name': 'other', 'description': 'y'}]",)], "p string")
    tools = parsers.tool_catalogue(prompts, "p")
    assert rows(parsers.tool_similarity(tools).select("tool", "substitute", "score"), "tool") == [("get_map_for_geo", "list_for_geo", 1.3), ("list_for_geo", "get_map_for_geo", 1.3)]
    view = "<function=str_replace_editor><parameter=command>view</parameter></function>"
    names = [r.t for r in spark.createDataFrame([(view,), ("please create file x",), ("locate it",), ("open file y",), ("hm",)], "c string").select(parsers.swe_tool(F.col("c")).alias("t")).collect()]
    assert names == ["view_file", "file_edit", "search_code", "view_file", None]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = spark.createDataFrame([("e", "a", 1), ("e", "b", 2), ("f", "c", 3)], "experiment_id string, id string, v int")
    store.save("things", frame, ["id"])
    store.save("things", frame.filter("id = 'a'").withColumn("v", F.lit(9)), ["id"])
    assert rows(store.read("things", experiment_id="e").select("id", "v"), "id") == [("a", 9), ("b", 2)]
    assert store.progress("e", ["things", "none"]) == {"things": 2, "none": 0}
    store.update("things", {"v": 0}, id="c")
    assert store.delete("things", experiment_id="e") == 2 and store.read("things").first().v == 0
    assert rows(status({"things": store.read("things")})) == [("things", 1)]
    with pytest.raises(KeyError):
        store.read("none")


def test_streaming_dedup(spark, tmp_path):
    from trailmetric import streaming

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:06")], "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("b",)], "k string")
    query = streaming.first_seen(streaming.pending(stream, done, "k"), "k", "t").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("seen").select("k")) == [("a",)]


def test_metric_edges(spark):
    empty = spark.createDataFrame([], "perturbation_class string, error_detected boolean, is_tp boolean, is_fp boolean, is_tn boolean, is_fn boolean, localization_correct boolean, localization_near boolean, type_correct boolean, expected_impact int, is_critical_detected boolean, error_confidence double")
    row = metrics.detection_metrics(empty).first()
    assert (row.n_total, row.pdr, row.sla, row.precision, row.detection_auc) == (0, None, None, 0.0, None)
    one = spark.createDataFrame([(1.0, 1.0), (-0.1, 0.0)], "p double, a double")
    bins = {r.bin: r.n for r in metrics.ece_bins(one, "p", "a").collect()}
    assert bins[9] == 1 and bins[0] == 1 and len(bins) == 10
    few = spark.createDataFrame([(0.5, True)], "predicted_failure_prob double, failure_actual boolean")
    assert metrics.failure_ece(few).first().failure_ece is None


def test_positions_of_a_whole_table(spark):
    """Every row has its position in hash order, and no window ranks all rows."""
    import hashlib

    from trailmetric.operators import sampling

    rows = spark.range(5000).unionByName(spark.range(3))
    got = sorted((r.position, r.id) for r in sampling.numbered(rows, "id").collect())
    order = sorted([*range(5000), *range(3)], key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == list(enumerate(order))
    plan = sampling.numbered(rows, "id")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.split("\n") if "Window" in line and "row_number()" in line]
    assert ranks and all("_range" in line for line in ranks)


def test_bad_trajectories_do_not_stop_the_others(spark):
    from trailmetric.operators import typing

    schema = "trajectory_id string, step_index int, raw_text string, tool_name string, tool_arguments string, observation string, step_type string, benchmark string"
    row = lambda t, i, args='{"a": 1}', b="gaia": (t, i, "First I plan to search", "search_code", args, "out", "reasoning", b)
    good = [row("good", 1), row("good", 2, None), row("good", 3, " ")]
    bad = [row("twice", 1), row("twice", 1), row(None, 1), row("none", 1), row("none", None), row("list", 1), row("list", 2, "[1]"), row("torn", 1, '{"a": '), row("where", 1, b=None), row("text", 1, '"x"')]
    steps, edges, rejected = typing.typed_or_rejected(spark.createDataFrame(good + bad, schema))
    assert {(r.trajectory_id, r.step_index) for r in steps.collect()} == {("good", i) for i in (1, 2, 3)}
    assert {r.trajectory_id for r in edges.collect()} <= {"good"}
    assert {(r.trajectory_id, r.error) for r in rejected.collect()} == {
        ("twice", "repeated step index"), (None, "no trajectory"), ("none", "no step index"), ("list", "arguments are no object"), ("torn", "arguments are no object"), ("where", "no benchmark"), ("text", "arguments are no object"),
    }
