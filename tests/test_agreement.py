"""Agreement of annotators by blocks: against all pairs in plain Python, and by plans that hold no pairs."""

import random
from itertools import combinations

import pytest

from trailmetric.operators import statistics as st


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def annotations(spark, people=70, units=40, seed=1):
    """Some rows are said again, some values, annotators and all values of an annotator are null; unit 0 is everyone's."""
    draw = random.Random(seed)
    rows = [(0 if draw.random() < 0.2 else draw.randrange(units), f"p{draw.randrange(people)}", draw.choice(["x", "y", "z", None])) for _ in range(people * units // 3)]
    rows += [(0, f"p{a}", draw.choice("xy")) for a in range(people)] + [(1, None, "x"), (2, None, "y"), (3, "silent", None), (None, "p1", "x"), (units, "alone", "x")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "u int, annotator_id string, v string, seq int").repartition(5)


def by_hand(df):
    """Last values by annotator and unit, and (shared, agreed) of every pair."""
    last = {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        if r.v is not None and r.u is not None:
            last.setdefault(r.annotator_id, {})[r.u] = r.v
    known = sorted(a for a in last if a is not None)
    return last, {(a, b): (len(both := last[a].keys() & last[b].keys()), sum(last[a][u] == last[b][u] for u in both)) for a, b in combinations(known, 2)}


def test_overall_agreement(spark):
    df = annotations(spark)
    _, pairs = by_hand(df)
    found = st.overall_agreement(df, "u", "annotator_id", "v")
    shared, agreed = (sum(p[i] for p in pairs.values()) for i in (0, 1))
    assert tuple(found.first()) == (shared, agreed, pytest.approx(agreed / shared))
    # Counts replace the pairs: 12.5 billion of them in one unit.
    hot = spark.range(158114).selectExpr("1 AS u", "id AS annotator_id", "id % 2 AS v", "id AS seq")
    row = st.overall_agreement(hot, "u", "annotator_id", "v").first()
    assert (row.shared, row.agreed) == (158114 * 158113 // 2, 79057 * 79056)
    frame = lambda rows: spark.createDataFrame(rows, "u int, annotator_id string, v string, seq int")
    overall = lambda rows: tuple(st.overall_agreement(frame(rows), "u", "annotator_id", "v").first())
    assert overall([]) == overall([(1, "a", "x", 1), (1, None, "x", 2)]) == (None, None, None)
    assert overall([(1, "a", "x", 1), (2, "b", "x", 2)]) == (0, 0, None)


@pytest.fixture(params=[(2, 1 << 21), (5, 50), (12, 1 << 21)])
def blocks(request, monkeypatch):
    """Blocks of 4, 32 and 4096 annotators, counted by one lot of votes or by many."""
    monkeypatch.setattr(st, "BITS", request.param[0])
    monkeypatch.setattr(st, "LOT", request.param[1])


def test_annotator_agreement(spark, blocks):
    df = annotations(spark)
    last, pairs = by_hand(df)
    found = st.annotator_agreement(df, "u", "annotator_id", "v")
    rates = {a: [agreed / shared for pair, (shared, agreed) in pairs.items() if a in pair and shared] for a in last}
    got = {r.annotator: (r.n_annotations, r.mean_agreement) for r in found.collect()}
    assert got == {a: (len(v), pytest.approx(sum(rates[a]) / len(rates[a])) if rates[a] else None) for a, v in last.items()}
    assert "a1" not in plan(found)  # no row holds a pair


def test_pairwise_agreement(spark, blocks):
    df = annotations(spark)
    _, pairs = by_hand(df)
    found = st.pairwise_agreement(df, "u", "annotator_id", "v")
    got = {(r.a1, r.a2): (r.shared, r.agreed, r.rate) for r in found.collect()}
    assert got == {pair: (shared, agreed, pytest.approx(agreed / shared) if shared else None) for pair, (shared, agreed) in pairs.items()}
    assert found.count() == len(pairs)
    # No pair is joined or shuffled: pairs come out of the last step.
    assert plan(found).count("a1#") <= 2 and "NestedLoopJoin BuildRight, Inner, (a1" not in plan(found)
    assert st.pairwise_agreement(df.limit(0), "u", "annotator_id", "v").count() == 0
