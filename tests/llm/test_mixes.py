"""Divergence of sources, clustering and mixing, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import agree
from trailmetric.llm import clusters, divergence, mixing, queries

DATA = "/root/testdata/sf0.01"
CLASHES = ("part", "item", "value", "rank", "total", "kept", "none", "terms", "cluster", "distance", "sums", "name", "key", "size", "n", "target", "x", "rate", "copies", "term", "docs")


def frame_of(spark, rows, schema):
    """With further columns of names that the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("?") for c in CLASHES})


# Operator 11


def plain_audit(rows, least=3, most=200):
    docs = [(lang or "", source or "", re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, n = Counter(), Counter()
        for la, so, words in docs:
            if la == lang:
                held.update(set(words))
        kept = {t for t, c in held.items() if c >= least}
        groups = {so: Counter() for la, so, _ in docs if la == lang}
        for la, so, words in docs:
            if la == lang:
                groups[so].update(w for w in words if w in kept)
                n.update(w for w in words if w in kept)
        at = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for so, c in groups.items():
            pairs = [(other, sum(f(at(c, t), at(d, t)) for t in kept)) for other, d in groups.items() if other != so]
            terms = [(t, f(at(c, t), at(n, t))) for t in kept if c[t] and at(c, t) > at(n, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, so, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < most]
    return sorted(out)


def audited(frame, **how):
    return sorted(tuple(r) for r in divergence.audit(frame, **how).select("lang", "source", "part", "item", "value", "rank").collect())


AUDIT = [
    ("Tea tea, coffee éclair", "en", "a"), ("tea COFFEE éclair", "en", "b"), ("tea coffee x1y", "en", None), ("tea\x00milk", "en", "c"), (None, "en", "d"), ("", "en", "a"),
    ("tea " * 50_000 + "milk", "en", "a"), ("milk milk", "en", "b"), ("tea coffee", "en", "b"), ("tea coffee", "en", "b"),
    ("un deux", "fr", "a"), ("un deux", None, "a"), ("123 !", "xx", "a"), ("", "xx", "b"), ("\U0001f600 Ä ä", None, None), ("Ä \U0001f600", "", ""), ("Ä \U0001f600", "", "q"),
]


def test_audit_against_brute_force(spark):
    frame = frame_of(spark, AUDIT, "text string, lang string, source string")
    for least, most in ((3, 200), (1, 2), (100, 5)):
        assert audited(frame, least_docs=least, terms=most) == plain_audit(AUDIT, least, most)
    assert audited(frame.repartition(7)) == plain_audit(AUDIT)
    assert audited(frame.limit(0)) == []


def test_audit_sends_counts_in_parts(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choices("abcdefghijklmnop", k=30)), rnd.choice(["en", "de"]), rnd.choice("pqrs")) for _ in range(120)]
    frame = frame_of(spark, rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "COUNTS_HELD", 10)
    assert audited(frame) == plain_audit(rows)


# Operator 12


def plain_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [max(-(1 << 62), min(1 << 62, math.floor(Fraction(x) * scale))) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        got = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if step < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), (_, c) in zip(kept, got, strict=True) if c == j]
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else at[j]
    long = (1 << 63) - 1
    got = [(min(d, long), c) for d, c in got]
    within = Counter()
    for d, c in got:
        within[c] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()
    return sorted(((i, c, d, min(within[c], long), min(sum(within.values()), long), digest(c)) for (i, _), (d, c) in zip(kept, got, strict=True)), key=str)


def clustered(frame, **how):
    return sorted((tuple(r) for r in clusters.cluster(frame, **how).collect()), key=str)


def test_clusters_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (7, [0.25] * 4), (None, [0.0] * 4), (None, [1.0] * 4)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 1.0, 1.0]), (1004, [float("nan")] * 4), (1005, [float("inf")] * 4)]
    frame = frame_of(spark, rows, "vec_id long, embedding array<float>")
    for k, rounds in ((12, 5), (400, 2), (1, 1), (5, 0)):
        assert clustered(frame, k=k, rounds=rounds, dims=4) == plain_clusters(rows, k, rounds, 4)
    far = rows[:40] + [(2000, [3e38, -3e38, 0.0, 0.0]), (2001, [1e9, 0.0, 0.0, 0.0]), (2002, [3e5] * 4)]
    assert clustered(frame_of(spark, far, "vec_id long, embedding array<float>"), k=9, rounds=3, dims=4) == plain_clusters(far, 9, 3, 4)
    assert clustered(frame.limit(0), dims=4) == [] and clustered(frame, dims=9) == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_scan_by_order_finds_the_nearest_and_the_first_of_ties(kind):
    rnd = np.random.default_rng(1)
    at = rnd.integers(-3, 4, (40, 3)).tolist()  # many ties, and equal centroids
    rows = rnd.integers(-4, 5, (500, 3)).astype(kind)
    every = np.stack([clusters.squared(rows, np.array(c, dtype=kind)) for c in at], axis=1)
    how = clusters.Centroids(at, kind)
    for last in (np.zeros(500, dtype=np.int64), rnd.integers(0, 40, 500)):
        cluster, distance = how.assign(rows, last)
        assert (cluster == every.astype(np.int64).argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    how.looked_at = 0
    how.assign(rows, cluster)
    assert how.looked_at < 500 * 39 // 2  # from the right centroid most others are never looked at


# Operator 13


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    whole, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        rest = whole - sum(most * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def held_to(rows, got, most=3, weights=(5, 2, 1)):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, smallest = Counter(), {}
    for _, text, source in rows:
        sizes[source] += size(text)
        if size(text):
            smallest[source] = min(size(text), smallest.get(source, 1 << 60))
    target, taken, source_of = plain_targets(sizes, weights, most), Counter(), {i: s for i, _, s in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-12) and 0 <= r.taken <= most * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s, t in target.items():
        # Half the smallest document, or a little more where the smallest are all at their bound.
        assert abs(taken[s] - t) <= max(1, smallest.get(s, 0) / 2 + 1e-6, 0.003 * t), (s, taken[s], float(t))


def corpus(seed, sources, n):
    rnd = random.Random(seed)
    return [(i, "w " * rnd.choice([0, 1, 1, 2, 7, 7, 40, rnd.randint(1, 900)]), rnd.choice(sources)) for i in range(n)]


def test_mix_meets_targets(spark):
    hot = [(i, "a b  c", "a") for i in range(400)] + [(1000, None, "b"), (1001, " \n", None), (1002, "x " * 60_000, "c"), (1003, "x", "d"), (1004, "", "e")]
    for rows in (corpus(1, ["b", "é", "A", None, "zz"], 400), corpus(2, ["one"], 50), hot, [(1, None, "a")], [(1, "a b", None), (2, "a", "")]):
        frame = frame_of(spark, rows, "doc_id long, text string, source string")
        frame = frame.drop("copies").withColumn("copies", F.lit(5))
        got = mixing.mix(frame).collect()
        held_to(rows, got)
        again = mixing.mix(frame.repartition(7)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mix_of_repeated_ids_and_other_weights(spark):
    rows = [(7, "a b c", "a")] * 5 + [(None, "a b", "b")] * 4 + [(8, "a", "b")]
    got = mixing.mix(frame_of(spark, rows, "doc_id long, text string, source string"), weights=(1,), most=2).collect()
    assert len(got) == 10 and {r.target for r in got} == {12.0} and all(r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got if r.size == 3) - 12) <= 1.5 and abs(sum(r.taken for r in got if r.size != 3) - 12) <= 1


def test_rates_are_tilted_exponentially(spark, tmp_path):
    """Rates of one source solve the dual: their logarithms are in proportion to sizes up to the bound."""
    cells = [("=a", s, n) for s, n in ((1, 50), (3, 20), (10, 10), (100, 2))]
    words, docs = sum(s * n for _, s, n in cells), sum(n for *_, n in cells)
    for target in (words * 0.01, words * 0.6, words * 1.9, words * 2.99):
        sources = spark.createDataFrame([("=a", words, docs, float(target))], "key string, words long, docs long, target double")
        frame = spark.createDataFrame(cells, "key string, size long, n long")
        x = mixing.solved(frame, sources, f"{tmp_path}/{target}", 3).first()
        total = sum(n * s * min(3.0, math.exp(x.x * s / x.mean)) for _, s, n in cells)
        assert abs(total - target) <= 0.3


def test_mix_of_the_table(spark):
    got = queries.QUERIES["op13_mixture"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    held_to([tuple(r) for r in docs], got)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_clusters"])
def test_query_agrees_in_other_partitions(spark, name):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
