import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmetric.functions import scoring as sc
from trailmetric.functions import text as tx
from trailmetric.operators import statistics as st


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("x")])
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize("od,signed,level", [(None, None, None), (0.0, 0, 0), (-0.3, 1, 0), (0.25, 1, 1), (0.26, 2, 2), (0.5, 2, 2), (0.51, 3, 3)])
def test_impact_levels(spark, od, signed, level):
    c = F.lit(od).cast("double")
    assert one(spark, sc.impact_level_signed(c)) == signed
    assert one(spark, sc.impact_level(c)) == level


@pytest.mark.parametrize("score,tier", [(0.0, 0), (0.25, 0), (0.5, 1), (0.75, 2), (0.76, 3)])
def test_tiers(spark, score, tier):
    assert one(spark, sc.score_tier(F.lit(score))) == tier


def test_gap_capped_and_not(spark):
    jps, tcs = F.lit(25.0), F.lit(110.0)
    assert one(spark, sc.ccg(jps, tcs)) == pytest.approx(-0.75)
    assert one(spark, sc.ccg(jps, tcs, capped=False)) == pytest.approx(-0.773, abs=1e-3)
    assert one(spark, sc.ccg(jps, F.lit(0.0))) is None


def test_localization(spark):
    steps = F.array(*map(F.lit, ("a", "b", "c", "b")))
    assert one(spark, sc.localization_distance(F.lit("a"), F.lit("b"), steps)) == 3  # the last of repeated ids
    assert one(spark, sc.localization_class(F.lit("a"), F.lit("a"), steps)) == "exact"
    assert one(spark, sc.localization_class(F.lit("c"), F.lit("b"), steps)) == "near"
    assert one(spark, sc.localization_class(F.lit(None).cast("string"), F.lit("b"), steps)) == "wrong"


def test_type_family(spark):
    assert one(spark, sc.type_family(F.lit("Planning"))) == "structural"
    assert one(spark, sc.type_family(F.lit("other"))) is None
    assert one(spark, sc.human_type_matches(F.lit("unclear"), F.lit("structural"))) is False


def test_baseline_outcome(spark):
    assert [one(spark, sc.baseline_outcome(F.lit(v).cast("boolean"))) for v in (True, False, None)] == [1.0, 0.0, 0.5]


def test_grading(spark):
    assert one(spark, tx.exact_match(F.lit("  The answer is  42 "), F.lit("42")))
    assert one(spark, tx.fuzzy_score(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, tx.fuzzy_score(F.lit("abc"), F.lit(""))) == 0.0
    assert one(spark, tx.fuzzy_score(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, tx.heuristic_score(F.lit("here is what I found"), F.lit(0))) == pytest.approx(0.7)
    assert one(spark, tx.heuristic_score(F.lit("sorry, error"), F.lit(1))) == pytest.approx(0.15)
    assert one(spark, tx.api_error(F.lit('{"error": ""}'))) is False
    assert one(spark, tx.api_error(F.lit('{"error": "denied"}'))) is True
    assert one(spark, tx.api_error(F.lit("read timeout"))) is True


def test_judge_output(spark):
    full = 'x ```json\n{"overall_score": 120, "error_detected": true, "error_confidence": 1.7, "predicted_error_step": 3, "predicted_impact_score": 0.2, "predicted_failure_prob": 0.1, "predicted_error_type": "planning"}\n```'
    row = one(spark, tx.judge_output(F.lit(full)))
    assert (row.parse_status, row.detection.overall_score, row.detection.error_confidence) == ("success", 100.0, 1.0)
    assert (row.localization.predicted_error_step, row.localization.predicted_error_type) == (3, "planning")
    failed = one(spark, tx.judge_output(F.lit("nothing")))
    assert failed.parse_status == "failed" and failed.detection.error_detected is False and failed.pair_comparison is None
    bare = one(spark, tx.judge_output(F.lit('{"error_detected": false}')))
    assert bare.parse_status == "success" and bare.detection.error_confidence == 0.0 and bare.localization is None
    broken = one(spark, tx.judge_output(F.lit('{"error_detected": true, "predicted_error_step": "x", "predicted_error_type": "odd"}')))
    assert broken.parse_status == "partial" and broken.localization is None
    pair = one(spark, tx.judge_output(F.lit('{"overall_score_a": 40, "overall_score_b": 60, "error_trajectory": "a", "preference": "none"}'), "blinded_pair"))
    assert (pair.detection.overall_score, pair.pair_comparison.error_trajectory, pair.pair_comparison.preference) == (50.0, "A", None)
    assert one(spark, tx.judge_output(F.lit('{"impact_estimate": 1.5}'), "labeled_pair")).impact.predicted_impact_score == 0.5
    for text, want in (("no idea", 1), ('{"class_matches": 0}', 0), ('{"class_matches": "Yes"}', 1), ("{}", 0), ('so {"class_matches": true}.', 1)):
        assert one(spark, tx.class_matches(F.lit(text))) == want


def test_trajectory_judgment(spark):
    said = '```json\n{"task_success": 1, "completeness": 0.5, "overall_score": 70, "step_errors": [{"step_index": 2, "error_type": "x", "severity": "minor", "description": "d"}, {"step_index": 3}]}\n```'
    row = one(spark, tx.trajectory_judgment(F.lit(said)))
    assert (row.task_success, row.completeness, row.overall_score, row.hallucination, len(row.step_errors)) == (1, 0.5, 70.0, 0, 1)
    assert one(spark, tx.trajectory_judgment(F.lit('{"task_success": 1}'))) is None and one(spark, tx.trajectory_judgment(F.lit("no"))) is None


def test_step_at(spark):
    frame = spark.createDataFrame([([("c1", "s1", None), (None, "s2", 9)],)], "steps array<struct<canonical_step_id: string, step_id: string, display_step_index: int>>")
    got = [frame.select(tx.step_at(F.lit(n), F.col("steps"))).first()[0] for n in (1, 2, 9, 3)]
    assert got == ["c1", "s2", "s2", None]


def test_semantic_difference(spark):
    pairs = [('{"observation": null, "content": "x"}', '{"content": null}', False), ('{"content": " A "}', '{"tool_output": "a"}', False), ('{"extracted_value": 1}', '{"extracted_value": 1.0005}', False), ('{"extracted_value": 1}', '{"extracted_value": 1.1}', True), ('{"content": {"a": 1}}', '{"content": {"a": 1}}', False), ('{"content": "1"}', '{"content": 1}', True), ('{"content": "x"}', "{}", True)]
    for a, b, want in pairs:
        assert one(spark, sc.outputs_differ(sc.step_output(F.lit(a)), sc.step_output(F.lit(b)))) is want, (a, b)


def test_ids(spark):
    unit = tx.unit_id(F.lit("a::b"), F.lit(7))
    assert one(spark, unit) == "eval::a::b::007"
    assert one(spark, tx.is_unit_id(unit)) and one(spark, tx.source_of(unit)) == "a::b"
    config = '{"k": 12}'
    suffix = one(spark, tx.config_suffix(F.lit(config)))
    assert "=" not in suffix and "+" not in suffix
    assert one(spark, tx.config_of(F.lit("exp_" + suffix))) == config


def test_propagation(spark):
    b, p = F.array(F.lit("x"), F.lit("Same "), F.lit("c")), F.array(F.lit("y"), F.lit("same"), F.lit("d"), F.lit("e"))
    r = one(spark, sc.propagation(b, p, F.lit(1)))
    assert (r.depth, r.divergent, r.convergent) == (2, [2, 3], [1])


def test_ranks_and_correlation_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    frame = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    want = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert st.spearman(frame, "x", "y").first().spearman == pytest.approx(want)
    got = st.with_ranks(frame, "x", "rk").toPandas().sort_values("x")
    assert sorted(got.rk) == pytest.approx(sorted(ranks(x)))
    assert st.pearson(frame.withColumn("y", F.lit(1.0)), "x", "y").first().pearson is None  # no variance
    assert st.spearman(frame.limit(2), "x", "y").first().spearman is None


def test_auc_is_symmetric(spark):
    frame = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, y boolean")
    a = st.auc(frame, F.col("y"), "s").first().auc
    assert a == pytest.approx(0.875) and st.auc(frame, ~F.col("y"), "s").first().auc == pytest.approx(1 - a)
    assert st.auc(frame.filter("y"), F.col("y"), "s").first().auc is None


def test_p_values():
    assert st.correlation_p_value(0.5, 20) == pytest.approx(0.0247, abs=1e-3)
    assert st.f_p_value(4.0, 2, 27) == pytest.approx(0.0301, abs=1e-3)
    assert math.isclose(st.beta_regularised(2, 3, 0.5), 0.6875)


def test_alpha(spark):
    frame = lambda found: spark.createDataFrame([(u, a, v, k) for k, (u, a, v) in enumerate(found)], "u int, annotator_id string, v string, seq int")
    alpha = lambda found, level="nominal": st.pooled_alpha(frame(found), "u", "v", level).first()
    assert alpha([(1, "x", "a"), (1, "y", "a"), (2, "x", "b"), (2, "y", "b")]).alpha == 1.0
    assert alpha([(1, "x", "a"), (1, "y", "a")]).alpha == 1.0  # one label
    half = alpha([(1, "x", "a"), (1, "y", "a"), (2, "x", "a"), (2, "y", "b")])
    assert half.alpha == pytest.approx(2 / 3) and half.band == "acceptable"
    # The last value of an annotator counts; units of one annotator don't.
    assert alpha([(1, "x", "b"), (1, "x", "a"), (1, "y", "a"), (2, "x", "a"), (2, "y", "b"), (3, "x", "c")]).alpha == pytest.approx(2 / 3)
    assert alpha([(1, "x", "a"), (2, "y", "b")]).band == "insufficient_data"
    assert alpha([(1, "x", "a"), (1, "y", "c"), (2, "x", "b"), (2, "y", "b")], "ordinal").alpha == pytest.approx(0.5)
    pairs = st.pairwise_agreement(frame([(1, "x", None), (1, "y", None), (2, "x", "a"), (2, "y", "a"), (3, "z", "a")]), "u", "annotator_id", "v").orderBy("a1", "a2").collect()
    assert [(r.a1, r.a2, r.shared, r.agreed) for r in pairs] == [("x", "y", 1, 1), ("x", "z", 0, 0), ("y", "z", 0, 0)]


def test_bootstrap(spark):
    frame = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("v"), (F.col("id") % 20).alias("x"), (F.col("id") % 20 + F.col("id") % 7).alias("y"))
    row = st.bootstrap_ci(frame, "m", "v", replicates=100).first()
    assert row.low < 0.5 < row.high and row.replicates == 100
    found, whole = st.correlation_interval(frame, "x", "y", replicates=100).first(), st.spearman(frame, "x", "y").first().spearman
    assert found.low < whole < found.high and found.high - found.low < 0.1
    assert st.correlation_interval(frame.limit(0), "x", "y", replicates=10).first().low is None


def test_hypothesis(spark):
    rows = [("early", "planning", -0.5 - i / 100) for i in range(9)] + [("late", "parameter", 0.4 + i / 100) for i in range(9)]
    found = st.assess_hypothesis(spark.createDataFrame(rows, "position string, perturbation_type string, ccg double")).first()
    assert found.criteria_met == 5 and found.support == "strong" and found.p_value < 1e-6
    none = st.assess_hypothesis(spark.createDataFrame(rows[:1], "position string, perturbation_type string, ccg double")).first()
    assert none.support == "not supported" and none.d is None and none.criteria_met == 1


def test_tukey(spark):
    frame = spark.createDataFrame([(g, float(v + 10 * (g == "c"))) for g in "abc" for v in range(8)], "g string, v double")
    found = {(r["group1"], r["group2"]): r["p"] for r in st.tukey_hsd(frame, "v", "g")}
    assert found["a", "c"] < 0.01 < 0.5 < found["a", "b"]


def test_capabilities_and_tiers(spark):
    assert [one(spark, tx.default_tier(F.lit(b))) for b in ("SWEbench", "gaia", "toolbench")] == [1, 3, None]
    assert one(spark, tx.capability(F.lit("gaia"), "can_replay", F.lit(True))) is True
    with pytest.raises(Exception, match="unknown benchmark"):
        one(spark, tx.capability(F.lit("other"), "can_replay"))


@pytest.mark.parametrize("criticality,affects,recoverable,kind,want", [(0.2, False, True, "fine_grained", 0), (0.2, True, False, "fine_grained", 1), (0.8, True, None, "fine_grained", 2), (None, None, None, "coarse_grained", 2), (0.9, True, False, "placebo", 0)])
def test_derived_impact(spark, criticality, affects, recoverable, kind, want):
    c = lambda v, t: F.lit(v).cast(t)
    assert one(spark, sc.impact_from_criticality(c(criticality, "double"), c(affects, "boolean"), c(recoverable, "boolean"), F.lit(kind))) == want


def test_claim_interval_is_over_all_rows(spark):
    """The interval lies around the gap of all rows and is about as wide as that of an index bootstrap."""
    import numpy as np

    from tests.oracle import DATA
    from trailmetric.operators import metrics
    from trailmetric.plans import QUERIES
    from trailmetric.plans.base import evaluated

    rows = evaluated(spark, DATA)
    got, gap = QUERIES["claim_interval"](spark, DATA).first(), metrics.main_claim(rows).first().gap
    t = rows.selectExpr("perturbation_class <> 'placebo' as real", "error_detected as hit", "predicted_impact as x", "outcome_degradation as y").toPandas()
    rng, gaps = np.random.default_rng(1), []
    for _ in range(100):
        s = t.iloc[rng.integers(0, len(t), len(t))]
        known = s.dropna(subset=["y"])
        gaps.append(s[s["real"]]["hit"].mean() - known["x"].rank().corr(known["y"].rank()))
    low, high = np.percentile(gaps, [2.5, 97.5])
    assert got.low < gap < got.high and 0.7 < (got.high - got.low) / (high - low) < 1.4
    assert tuple(metrics.claim_interval(rows.limit(9), replicates=20).first()) == (None, None)


def test_ranks_of_replicates(spark):
    """Weighted ranks in every replicate equal those of the repeated rows."""
    frame = spark.range(300).selectExpr("cast(id * 37 % 101 as double) as x", "if(id % 11 = 0, null, cast(id * id % 53 as double)) as y")
    drawn = st.poisson_replicates(frame, ["x", "y"], replicates=20).cache()
    t = drawn.toPandas()
    assert 250 < t.groupby("replicate")["w"].sum().mean() < 350
    for r in st.replicate_spearman(drawn, "x", "y").collect():
        own = t[t["replicate"] == r.replicate].dropna()
        own = own.loc[own.index.repeat(own["w"])]
        assert own["x"].rank().corr(own["y"].rank()) == pytest.approx(r.r, abs=1e-9)


def test_bootstrap_query_has_all_replicates(spark):
    from tests.oracle import DATA
    from trailmetric.plans import QUERIES

    assert QUERIES["bootstrap_ci"](spark, DATA).first().replicates == 1000


@pytest.mark.parametrize("q, k, df, p", [(3.877, 3, 10, 0.05), (3.958, 4, 20, 0.05), (5.270, 3, 10, 0.01), (3.685, 4, 120, 0.05), (17.97, 2, 1, 0.05), (4.468, 9, 120, 0.05)])
def test_studentised_range_against_tables(q, k, df, p):
    from trailmetric.operators import statistics as st

    assert abs(st.studentised_range_tail(q, k, df) - p) < 3e-4


@pytest.mark.parametrize("df", [1, 2, 5, 30, 400])
@pytest.mark.parametrize("q", [0.3, 1.5, 4.0, 9.0])
def test_studentised_range_of_two_is_students_t(q, df):
    from trailmetric.operators import statistics as st

    want = st.beta_regularised(df / 2, 0.5, df / (df + q * q / 2))
    assert abs(st.studentised_range_tail(q, 2, df) - want) < 1e-6


def test_poisson_draws_have_mean_and_variance_of_their_size(spark):
    """Sizes with one bit, several bits and beyond exact inversion; the same in any partitioning."""
    sizes = {"a": 1, "b": 7, "c": 31, "d": 32, "e": 1000}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k string")
    drawn = st.poisson_replicates(rows.repartition(7), ["k"], replicates=4000)
    for r in drawn.groupBy("k").agg((F.sum("w") / 4000).alias("m"), (F.sum(F.col("w") * F.col("w")) / 4000).alias("s")).collect():
        n = sizes[r.k]
        assert r.m == pytest.approx(n, abs=5 * (n / 4000) ** 0.5) and r.s - r.m**2 == pytest.approx(n, rel=0.15)
    again = st.poisson_replicates(rows.coalesce(1), ["k"], replicates=50).collect()
    assert sorted(again) == sorted(st.poisson_replicates(rows, ["k"], replicates=50).collect())
    assert sorted(st.poisson_replicates(rows.limit(0), ["k"], replicates=50).collect()) == []


def test_poisson_thresholds():
    import math

    marks = st.poisson_thresholds(1)
    assert marks[0] == math.floor(math.exp(-1) * 2**32) and marks == sorted(marks) and 10 <= len(marks) <= 14


def test_keys_of_draws(spark):
    """Nulls, signed zeros and values without a number are cells like any other."""
    rows = spark.createDataFrame([(None, True), (float("nan"), None), (-0.0, False), (0.0, False), (float("inf"), True), (1e300, True)], "x double, b boolean")
    drawn = st.poisson_replicates(rows, ["x", "b"], replicates=200)
    assert drawn.select("x", "b").distinct().count() == 5
