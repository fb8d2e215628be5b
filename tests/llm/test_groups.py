"""Dedup, search, licences, PII and the pipeline, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import agree
from tests.oracle import rows as oracle_rows
from trailmetric.llm import exact_dedup, licenses, near_dedup, pii, queries, topk

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def frame_of(spark, rows):
    """With further columns of names that the operators use themselves."""
    extra = {c: F.lit(1) for c in ("norm", "size", "rep", "key", "a", "b", "label", "hash", "n", "variant", "gone_id", "own_sha", "own_key", "stay_id", "version", "terms", "doc", "pii_text", "lines", "license")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


EDGES = [(5, None), (6, ""), (7, " \n"), (1, "a b c d"), (2, "a  b c d"), (3, "ab cd"), (4, "A b c d"), (8, "x " * 40_000), (9, "x " * 40_000), (10, "two words")]


def test_exact_groups_with_colliding_hashes(spark):
    rows = EDGES + [(1, "a b c d")]
    want = {}
    for i, t in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    same = lambda norm: F.lit("x")
    # With a weak hash, and also with a weak digest, only the bytes tell texts apart.
    for how in ({}, {"hash128": same}, {"hash128": same, "digest": same}, {"hash128": lambda norm: F.substring(F.md5(norm), 1, 1)}):
        got = exact_dedup.groups(frame_of(spark, rows), **how).collect()
        assert len(got) == len(rows)
        for r, t in ((r, t) for r in got for i, t in rows if i == r.doc_id):
            norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert (r.keep_id, r.group_size) == (min(want[norm])[1], len(want[norm])) and r.kept == (r.doc_id == r.keep_id)
            assert r.text_sha256 == ("x" if "digest" in how else hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.groups(frame_of(spark, rows).limit(0)).count() == 0


def test_exact_dedup_keeps_one_row_a_group(spark):
    for rows, n in ((EDGES, 5), (EDGES + [(1, "a b c d"), (3, "other")], 6)):
        frame = frame_of(spark, rows)
        kept = exact_dedup.deduplicate(frame)
        assert kept.columns == frame.columns and kept.count() == n


def components(rows, size, percent):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (common and 100 * common >= percent * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    groups = {}
    for k in sets:
        groups.setdefault(root(k), []).append(rows[k][0])
    return {rows[k][0]: min(groups[root(k)]) for k in sets}, {k: len(s) for k, s in sets.items()}


def near_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 150]))] + passage * (g % 2)
        for _ in range(rng.choice([1, 3, 9])):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(words).title() if rng.random() < 0.3 else " ".join(words)))
    return rows


@pytest.mark.parametrize("size,percent,split", [(3, 85, False), (5, 80, True)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, size, percent, split):
    if split:  # hot keys and buckets in many parts
        monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 2)
        monkeypatch.setattr(near_dedup, "MEMBERS_AT_ONCE", 3)
    for rows in (near_rows(), [r for r in EDGES if r[0] != 6]):
        want, sizes = components(rows, size, percent)
        got = near_dedup.near_duplicates(frame_of(spark, rows), size, percent).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert sorted(r.n_shingles for r in got) == sorted(sizes.values())
    assert near_dedup.near_duplicates(frame_of(spark, rows).limit(0)).count() == 0


def test_rows_without_an_id(spark):
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "")]
    got = near_dedup.near_duplicates(frame_of(spark, rows)).collect()
    assert len(got) == 4 and {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2}
    assert near_dedup.deduplicate(frame_of(spark, rows)).filter("doc_id is not null").count() == 2
    assert exact_dedup.groups(frame_of(spark, rows)).count() == 4
    assert {r.doc_id for r in exact_dedup.deduplicate(frame_of(spark, rows)).collect()} >= {1}
    assert pii.find(frame_of(spark, rows)).count() == 4 and pii.sanitise(frame_of(spark, rows)).count() == 4
    assert queries.packed(frame_of(spark, rows).select("doc_id", "text")).select("doc_id").distinct().count() == 3


def test_unlike_texts_of_one_id_stay(spark):
    far = [" ".join(f"{w}{i}" for i in range(30)) for w in "pqrst"]
    rows = [(None, far[0]), (None, far[1]), (3, far[2]), (3, far[3]), (-4, far[3]), (None, far[3]), (5, far[4]), (5, far[4]), (10, far[4]), (6, None), (6, "")]
    got = near_dedup.deduplicate(frame_of(spark, rows)).select("doc_id", "text").collect()
    want = [(None, far[0]), (None, far[1]), (3, far[2]), (-4, far[3]), (5, far[4]), (6, None), (6, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_dedup.deduplicate(frame_of(spark, [(None, far[0]), (1, far[0])])).collect()[0].doc_id == 1


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_signature_guarantee():
    for percent in (80, 85):
        chunks = near_dedup.chunks_for(percent)
        most = near_dedup.distance(chunks)
        rng = random.Random(percent)
        for _ in range(300):  # any choice of that many errors leaves a chunk with ERRORS at most
            wrong = rng.sample(range(chunks * near_dedup.POSITIONS), most)
            per = [sum(w // near_dedup.POSITIONS == c for w in wrong) for c in range(chunks)]
            assert min(per) <= near_dedup.ERRORS


def test_sketch_never_rules_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(2, 3000))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 1 << 62, max(1, n // 20)).astype(np.uint64)]))
        x, y = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
        assert sum(int(v).bit_count() for v in (x ^ y)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_a_bucket_are_compared_by_compiled_code(spark, monkeypatch, capsys, percent):
    chunks, plans = near_dedup.chunks_for(percent), []
    rows = near_dedup.described(frame_of(spark, [(i, f"a b c d {i % 2}") for i in range(4)]), 3, chunks, "doc_id", "text")
    rest = rows.withColumns({"rep": F.col("doc_id"), "label": F.col("doc_id"), "hub": F.col("doc_id") + 9, "key": F.explode(near_dedup.bucket_keys(chunks)), "band": near_dedup.size_band(percent)})
    monkeypatch.setattr(near_dedup, "checkpointed", lambda df: plans.append(df) or df)
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        near_dedup.bucket_pairs(rest, chunks, percent)
        plans[0].explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    longest = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert longest and max(longest) <= 8000  # the JVM only interprets longer methods


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_a_bucket_are_planned_with_few_constraints(spark, monkeypatch, percent):
    chunks, plans = near_dedup.chunks_for(percent), []
    rows = near_dedup.described(frame_of(spark, [(i, f"a b c d {i % 2}") for i in range(4)]), 3, chunks, "doc_id", "text")
    rest = rows.withColumns({"rep": F.col("doc_id"), "label": F.col("doc_id"), "hub": F.col("doc_id") + 9, "key": F.explode(near_dedup.bucket_keys(chunks)), "band": near_dedup.size_band(percent)})
    monkeypatch.setattr(near_dedup, "checkpointed", lambda df: plans.append(df) or df)
    near_dedup.bucket_pairs(rest, chunks, percent)

    def most(plan):
        return max([plan.validConstraints().size(), *[most(plan.children().apply(i)) for i in range(plan.children().size())]])

    assert most(plans[0]._jdf.queryExecution().optimizedPlan()) < 400  # 2 ** (chunks + 1) and more, if each name of a chunk counts with each of the others


def test_signature_distance_counts_positions(spark):
    chunks, rng = 3, np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[:30], sets[0][:8]])) for s in sets]
    words = [[int(w) for w in near_dedup.signature(s, chunks)] for s in sets]
    rows = spark.createDataFrame([(i, *w) for i, w in enumerate(words)], ["i", *[f"c{i}" for i in range(chunks)]])
    x, y = (rows.select(*[F.col(c).alias(p + c) for c in rows.columns]) for p in "xy")
    got = {(r.xi, r.yi): r.d for r in x.crossJoin(y).select("xi", "yi", near_dedup.signature_distance("x", "y", chunks).alias("d")).collect()}
    parts = [[w >> near_dedup.LANE * j & (1 << near_dedup.BITS) - 1 for w in ws for j in range(near_dedup.POSITIONS)] for ws in words]
    assert got == {(i, k): sum(a != b for a, b in zip(parts[i], parts[k])) for i in range(len(sets)) for k in range(len(sets))}
    assert len(set(got.values())) > 3


LONG = (1 << 63) - 1


def brute_top(rows, k=5):
    held = lambda x: max(-LONG - 1, min(LONG, x))
    terms = {i: [held(math.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, t in terms.items():
        if q % 50 == 0:
            scores = sorted((-held(sum(a * b for a, b in zip(t, u))), i) for i, u in terms.items() if i != q and len(u) == len(t))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_top_k_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    rows += [(i + 1000, rows[7][1]) for i in range(20)]  # ties
    rows += [(i * 50 + 2000, rows[9][1]) for i in range(9)]  # queries of one vector
    rows += [(400, None), (450, []), (500, [1.0, None]), (550, [float("nan")] * 6), (600, [float("inf")] * 6), (650, [1.0, 2.0]), (651, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[7][1]), (50, rows[50][1])]
    frame = lambda found: spark.createDataFrame(found, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("score", "dims", "cell", "terms", "bound")})
    for name, value in (("SHARE_ROWS", 100), ("LOT_ROWS", 3), ("SAMPLE_ROWS", 200), ("CELL_SAMPLE", 20), ("SCORES_AT_ONCE", 300)):
        monkeypatch.setattr(topk, name, value)
    huge = rows + [(700, [1e15] * 6), (701, [-1e15] * 6), (702, [1e17] * 6), (703, [3e17] * 6), (704, [1e300] * 6)]
    for some in (rows, huge, rows[:3], rows[:1]):
        got = topk.top_k(frame(some), F.col("vec_id") % 50 == 0)
        assert {tuple(r) for r in got.collect()} == brute_top(some)
    assert topk.top_k(frame(rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("bits", [9, 28, 60])
def test_blocks_are_searched_exactly(bits):
    """Within what doubles hold and beyond it, with floors and ties."""
    rng = np.random.default_rng(bits)
    terms = rng.integers(-(1 << bits), 1 << bits, (200, 8))
    terms[50:60] = terms[3]
    index = topk.BlockIndex(np.arange(200), terms)
    for k in (1, 5, 300):
        for q in (3, 90):
            scores = sorted((-max(-LONG - 1, min(LONG, int((terms[q].astype(object) * t.astype(object)).sum()))), i) for i, t in enumerate(terms))
            floor = -np.inf if q == 3 else float(np.nextafter(-scores[2][0], -np.inf))
            want = [(i, -s) for s, i in scores[:k] if -s >= floor]
            assert [(i, s) for _, i, s in index.search(np.array([q]), terms[q : q + 1], k, np.array([floor]))] == want


def test_bounds_leave_blocks_out():
    """Alike rows stand in one block, and blocks whose bound is below the k-th score are not scored."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 16))
    terms = np.repeat(centres, 16, axis=0) + rng.integers(-5, 5, (640, 16))
    index = topk.BlockIndex(np.arange(640), terms)
    bounds = topk._bounds(terms[:1].astype(float), index.most.astype(float), index.least.astype(float))
    kth = np.sort(terms @ terms[0])[-5]
    assert (bounds >= kth).sum() <= 2 and len(list(index.search(np.array([0]), terms[:1], 5))) == 5


def test_licences(spark):
    mit = dict(reversed(licenses.KNOWN[:1]))["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
        (2, "text\nlicensed under the MIT licence!\nmore\nReleased under the MIT License."),
        (3, None),
        (4, mit[:-10]),
        (5, "Licensed under CC BY-NC 4.0."),
    ]
    again = licenses.scan(frame_of(spark, rows + rows[1:2] + [(2, "other"), (None, "x"), (6, "y " * 50_000)])).collect()
    assert sorted((r.license or "", r.notices) for r in again if r.doc_id == 2) == [("", ""), ("", "MIT"), ("", "MIT")] and len(again) == 9
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(frame_of(spark, rows)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0")}
    assert licenses.scan(frame_of(spark, rows).limit(0)).count() == 0


def test_licences_as_published(spark):
    """With title, copyright lines and wrapped lines; whole long licences; lines that only begin with the word stay."""
    import textwrap

    from trailmetric.llm.license_texts import TEXTS

    short = dict(reversed(licenses._SHORT[:6]))
    wrapped = {n: "\n".join(textwrap.fill(line, 70) for line in t.split("\n")) for n, t in short.items()}
    isc = wrapped["ISC"].replace("that the above copyright notice", "that the above\ncopyright notice")
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A B\n\n" + wrapped["MIT"]),
        ("MIT", "The MIT License (MIT)\n\nCopyright Some One\n\n" + wrapped["MIT"]),
        ("ISC", "ISC License\n\n(c) 2019, C D <c@d.org>\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2001, E\nAll rights reserved.\n\n" + wrapped["BSD-3-Clause"].replace("\n3. ", "\n* ").replace("\n2. ", "\n* ").replace("\n1. ", "\n* ")),
        *[(n, t) for n, t in TEXTS],
        ("Apache-2.0", TEXTS[0][1].replace("[yyyy] [name of copyright owner]", "2021 F G").split("   END OF TERMS")[0]),
    ]
    got = {r.doc_id: r.license for r in licenses.scan(frame_of(spark, list(enumerate(t for _, t in files)))).collect()}
    assert [got[i] for i in range(len(files))] == [n for n, _ in files]
    body = [(1, "one\ncopyright notice two"), (2, "one\ntwo"), (3, "one\n(c) you must"), (4, "one\ncopyright 2020 x"), (5, "one"), (6, "one\ncopyrighted works")]
    digest = {r.doc_id: r.text_digest for r in licenses.scan(frame_of(spark, body)).collect()}
    assert len(set(digest.values())) == 5 and digest[4] == digest[5]


def test_licences_of_one_digest_are_all_named(spark):
    texts = [("B", "Some  notice."), ("A", "some notice"), ("C", "other notice")]
    rows = [(1, "SOME notice!"), (2, "x\nother notice\nsome notice"), (None, None), (3, "x")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(frame_of(spark, rows), texts=texts).collect()}
    assert got == {1: ("A,B", "A,B"), 2: (None, "A,B,C"), None: (None, ""), 3: (None, "")}


def test_pii_query_against_sql_with_disclosing_terms(spark, tmp_path):
    """Terms by whole documents, windows, copies, overlapping and repeated entities, nulls: each row as the SQL has it."""
    import duckdb

    rng = random.Random(11)
    people = [("bob@x.org", "smithers agent"), ("10.0.0.7", "gateway cellar"), ("+1 (555) 123-4567", "caller"), ("4111 1111 1111 1111", "wallet"), ("al@y.net", "")]
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        said = rng.sample(words, rng.randrange(1, 12))
        for entity, terms in rng.sample(people, rng.choice([0, 0, 0, 1, 2])):
            said.insert(rng.randrange(len(said) + 1), rng.choice([entity, entity.upper(), f"{entity},{entity}"]))
            said += [t.title() if rng.random() < 0.3 else t for t in terms.split() if rng.random() < 0.9]
        rows.append((i // 2 if i % 40 == 0 else i, " ".join(said)))
    rows += [(1000 + i, "one copy of a@b.cc with oddword") for i in range(30)] + [(None, "agent smithers bob@x.org"), (None, None), (2000, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = oracle_rows(queries.op5_pii(spark, str(tmp_path)).toPandas()), oracle_rows(con.sql(queries.ORACLE_SQL["op5_pii"]).df())
    assert got == want and sum("term:" in str(r) for r in got) > 50 and sum("term:" in str(r) for r in got) < 250


def luhn(digits):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


# The contract's patterns.
CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["a@b.c", "x", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "1", "23", " ", "-", "(", ")", "_foo@bar.com", "é", "😀", "+1 (555) 123-4567", "000", "12345678", "\n", "%", "5500005555555559"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(13)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 30_000), (9003, "a" * 50_000), (9004, "1 " * 30_000), (9005, ("x@y.zz " * 300)), (9006, "a." * 20_000 + "@b.c")]
    monkeypatch.setattr(queries, "documents", lambda *_: frame_of(spark, rows).select("doc_id", "text"))
    got = {r.doc_id: r for r in queries.op5_pii(spark, "").collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert got[i].n_email == sum(w.startswith("email") for w in want) and got[i].spans.startswith(",".join(want))


def test_disclosing_terms(spark):
    rows = [(i, f"common words here w{i} agent smithers mail bob@x.org v{i} and u{i} more") for i in range(5)]
    rows += [(100 + i, f"common words here and mail more z{i}") for i in range(200)]
    rows += [(300 + i, "same text again with odd neighbour of al@y.org only copies") for i in range(20)]  # copies are no evidence
    found = {r.doc_id: r.terms for r in pii.find(frame_of(spark, rows)).collect()}
    text = rows[0][1]
    assert [text[int(a) : int(b)] for _, a, b in (t.split(":") for t in found[0])] == ["agent", "smithers"]
    assert all(not t for i, t in found.items() if i >= 5)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame_of(spark, rows)).collect()}
    assert "smithers" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[5][1] and len(clean) == len(rows)


def test_terms_far_from_their_entity(spark):
    """A term disclosed by whole documents, wherever it stands; copies and near copies are no evidence."""
    rows = [(i, f"smithers{' x' * 40} a{i} mail bob@x.org b{i}{' x' * 40} Smithers") for i in range(4)] + [(None, "smithers and c1 bob@x.org d1")]
    rows += [(10 + i, f"x and mail text n{i}") for i in range(100)]
    rows += [(200 + i, f"odd neighbour far far far off of al@y.org in near copies {i // 5}") for i in range(20)]
    found = pii.find(frame_of(spark, rows)).collect()
    cut = lambda r, text: [text[int(a) : int(b)] for _, a, b in (t.split(":") for t in r.terms)]
    by = {r.doc_id: r for r in found}
    assert all(cut(by[i], rows[i][1]) == ["smithers", "Smithers"] for i in range(4)) and cut(by[None], rows[4][1]) == ["smithers"]
    assert not any(r.terms for r in found if r.doc_id is not None and r.doc_id >= 10)


def test_sanitise_keeps_rows_and_nulls(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc and 10.0.0.1"), (3, "other 10.0.0.1"), (4, "no data")]
    frame = frame_of(spark, rows)
    out = pii.sanitise(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, ""), (2, ""), (3, "[EMAIL] and [IP]"), (3, "other [IP]"), (4, "no data")]
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, left = [i for i, q in labels.items() if q == 1], kept["quality"]
    assert sum(i in left for i in good) / len(good) > 0.97 and sum(i in left for i, q in labels.items() if q == 0) <= 3
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len(kept["exact_dedup"]) == len({norm(t) for t in left.values()})
    want, _ = components(list(kept["exact_dedup"].items()), 5, 80)
    assert set(kept["near_dedup"]) == set(want.values())
    assert all(not base_spans(t) for t in kept["pii"].values())
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept["pii"])


def test_tables_without_rows(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
