"""Tokenisers, packing, classifiers: against the public libraries, brute force or held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmetric.llm import bpe, packing, quality, queries, token_counts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", "é", "日", "!", "..", "　", "\xa0", "\x1c", "<|endoftext|>", "<|endof", "😀", "\r\n", "'", "l", "v", "Σ", "İ", "é"]
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, "x" * 70_000), (7, "Hello, World! 12 " * 3000), (None, "no id"), (8, "<|endoftext|> x")]


@pytest.fixture(scope="module")
def byte():
    return bpe.load(BYTE), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return token_counts.load(WORD), Tokenizer.from_file(WORD)


def docs(spark, rows):
    """With further columns of names that the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({"ids": F.lit(0), "n_tokens": F.lit(1), "score": F.lit(2), "lang": F.lit("en")})


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=40))
def test_byte_bpe_equals_library(text):
    own, library = bpe.load(BYTE), Tokenizer.from_file(BYTE) if not hasattr(test_byte_bpe_equals_library, "t") else test_byte_bpe_equals_library.t
    test_byte_bpe_equals_library.t = library
    found = own.encode(text)
    assert found == ids(library, text)
    assert own.decode(found) == library.decode(found, skip_special_tokens=False)
    assert packing.load(BYTE).encode(text, 0).tolist() == [*found, 0]


def test_any_ids_decode_like_library(byte):
    rng = random.Random(5)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        assert byte[0].decode(some) == byte[1].decode(some, skip_special_tokens=False)
    assert byte[0].decode([None, -1, 10**6]) == ""


def test_memo_overflow_keeps_results(byte, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    fresh = bpe.ByteBpe(BYTE)
    for text in ("one two three four five six", "six five four three two one"):
        assert fresh.encode(text) == ids(byte[1], text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.integers(1, 9))
def test_token_counts_equal_library(text, chunk):
    own = token_counts.load(WORD)
    library = getattr(test_token_counts_equal_library, "t", None) or Tokenizer.from_file(WORD)
    test_token_counts_equal_library.t = library
    want = len(ids(library, text))
    assert own.count(text) == want
    assert own.count(text, chunk=chunk) == want  # chunk maps compose to the same count


def test_token_counts_beyond_the_compiled_states(word, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    small = token_counts.Transducer(WORD)
    text = "Antidisestablishmentarianism isn't the longest we'll see 123 !!"
    assert small.count(text) == len(ids(word[1], text)) and len(small.states) <= 20


@pytest.mark.parametrize("unit", ["x", "q8Zk+/7", "日本語の文章", "''ll're", "ab c", "!?"])
def test_no_character_is_advanced_more_than_twice(word, monkeypatch, unit):
    run, text, ran = token_counts.Transducer.advance, (unit * 20_000)[:20_000], []
    monkeypatch.setattr(token_counts.Transducer, "advance", lambda self, state, part: ran.append(len(part)) or run(self, state, part))
    assert token_counts.load(WORD).count(text, chunk=64) == len(ids(word[1], text))
    assert sum(ran) <= 2 * len(text)


def test_scan_is_an_inclusive_prefix():
    for n in range(9):
        assert token_counts.scan(list("abcdefgh"[:n]), lambda a, b: a + b) == ["abcdefgh"[: i + 1] for i in range(n)]


def test_round_trip_query(spark, byte, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs(spark, EDGES).select("doc_id", "text"))
    got = sorted(tuple(r) for r in queries.op2_bpe_round_trip(spark, "").fillna({"doc_id": -1}).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((-1 if i is None else i, len(ids(byte[1], t)), sha(",".join(map(str, ids(byte[1], t)))), sha(t or "")) for i, t in EDGES)
    assert got == want


def test_counts_query(spark, word, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs(spark, EDGES).select("doc_id", "text"))
    got = sorted(tuple(r) for r in queries.op10_token_counts(spark, "").fillna({"doc_id": -1}).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(ids(word[1], t)), n > 2048) for i, t in EDGES)
    assert got == want


def check_packing(rows, texts, tokenizer):
    whole = {}
    for i, t in texts:
        whole.setdefault(i, []).append([*ids(tokenizer, t), 0])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(whole)
    for i, found in pieces.items():
        if len(whole[i]) > 1:
            continue
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            part = whole[i][0][at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole[i][0]), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
            at += r.length
        assert at == len(whole[i][0])
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sum(r.length for r in rows) == sum(len(x) for found in whole.values() for x in found)
    return padding / max(total, 1)


def test_packing_of_documents(spark, byte):
    frame = queries.documents(spark, "/root/testdata/sf0.001")
    texts = [tuple(r) for r in frame.collect()]
    assert check_packing(queries.packed(frame.repartition(3)).collect(), texts, byte[1]) < 0.001


def test_packing_of_edges(spark, byte):
    frame, texts = docs(spark, EDGES), EDGES
    check_packing(queries.packed(frame).collect(), texts, byte[1])
    assert queries.packed(frame.limit(0)).count() == 0


def test_segment_limit_holds():
    packer = packing.DocumentPacker(tokens=64, segments=3, loss=64, pool=16)
    found = []
    for i in range(200):
        found += packer.add(i, np.array([1] * (i % 9) + [0], dtype="<u4"))
    found += packer.finish()
    held = {}
    for (_, _, part, _), sequence, _ in found:
        held.setdefault(sequence, []).append(len(part))
    assert all(len(v) <= 3 and sum(v) <= 64 for v in held.values())
    assert sum(map(sum, held.values())) == sum(i % 9 + 1 for i in range(200))


def test_whole_examples(spark):
    frame = spark.range(300).select(F.col("id"), (F.col("id") % 90 + 1).alias("tokens"), F.lit(1).alias("segments"), (F.col("id") % 40).alias("loss"))
    got = packing.pack_examples(frame.coalesce(1), "id", ["tokens", "segments", "loss"], (100, 4, 60))
    joined = got.join(frame, F.col("example_id") == F.col("id")).groupBy("sequence_id").agg(F.sum("tokens").alias("t"), F.count("id").alias("n"), F.sum("loss").alias("l"))
    assert got.count() == 300 and joined.filter("t > 100 or n > 4 or l > 60").count() == 0
    assert joined.count() < 300 * 45.5 / 100 * 1.3
    with pytest.raises(Exception, match="needs"):
        packing.pack_examples(frame, "id", ["tokens", "segments", "loss"], (10, 4, 60)).count()


DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,need", [("op4_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.95)])
def test_classifiers_on_held_out_rows(spark, name, label, need):
    scored = queries.QUERIES[name](spark, DATA)
    rows = scored.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").select(label, "score", "predicted").collect()
    truth, guess = np.array([r[0] for r in rows]), np.array([r.predicted for r in rows])
    assert len(rows) > 300 and (truth == guess).mean() > need
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_edges(spark, operator):
    frame = docs(spark, [(i, t) for i, t in EDGES]).drop("score")
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, 0), (6, 1), (7, 0), (7, 1), (None, 1), (99, None)], f"doc_id long, {'quality' if operator is quality else 'toxic'} int")
    for some in (labels, labels.limit(0), labels.filter("doc_id in (2, 4)")):
        out = operator.score(frame, operator.train(frame, some), carry=["doc_id", "lang"]).collect()
        assert len(out) == len(EDGES) and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert operator.score(frame.limit(0), operator.train(frame, labels.limit(0)), carry=["doc_id"]).count() == 0


def test_offending_sentences_are_located(spark):
    clean = [(i, f"nice day {i}. all good here {i}.") for i in range(60)]
    toxic = [(100 + i, f"nice day {i}. you moron {i}! all good here.") for i in range(40)]
    frame = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("toxic"))
    got = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert all(r.score < 0.5 for i, r in got.items() if i < 100) and all(r.score > 0.5 for i, r in got.items() if i >= 100)
    text = toxic[0][1]
    assert ["moron" in text[s.start : s.end] for s in got[100].offending] == [True]


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 200)
    feature = np.concatenate([label, 2 + rng.integers(0, 50, 200)])
    row = np.concatenate([np.arange(200), np.arange(200)])
    order = np.argsort(row, kind="stable")
    model = quality.fit(row[order], feature[order], label, buckets=64)
    assert ((model.scores(row[order], feature[order], 200) > 0.5) == (label == 1)).all()


def test_dual_descent_against_a_plain_solver():
    """The dual's box-constrained quadratic programme by projected gradient."""
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 40)
    x = (rng.random((40, 12)) < 0.4) * rng.normal(size=12)
    row, feature = np.nonzero(x)
    w, bias = quality.dual_coordinate_descent(row, feature, x[row, feature], label, 12, epochs=3000)
    y, held = np.where(label == 1, 1.0, -1.0), np.c_[x, np.ones(40)]
    q = (held @ held.T) * np.outer(y, y)
    share = label.mean()
    upper = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, upper)
    primal = lambda v: v @ v / 2 + (upper * np.maximum(0, 1 - y * (held @ v))).sum()
    assert abs(primal(np.append(w, bias)) - primal((alpha * y) @ held)) < 1e-2 * primal((alpha * y) @ held)


def test_quality_features_hold_words_and_whole_shapes():
    of = lambda text: set(quality.features([text])[1].tolist())
    assert of("aaaa-bbbb-cccc-1-d") != of("aaaa-bbbb-cccc-1-")  # beyond the twelfth sign of a shape
    assert len(of("one") & of("two")) == 1  # alike in shape, not in word
    assert of("One.") & of("one") and quality.features([None, "", " \n"])[0].size == 0


def test_noisy_or_and_its_gradient():
    texts = ["You fool. Nice day! ok", "nice day", "", "fool fool? day", "Ok ok."]
    numbers: dict[str, int] = {}
    sentences, lengths, words = toxicity._bags(texts, lambda w: numbers.setdefault(w, len(numbers)))
    held = [toxicity.parts(w) for w in numbers]
    of_word, feature = zip(*((k, f) for k, found in enumerate(held) for f in found))
    bags = toxicity.Bags(np.array([1, 0, 0, 1, 0]), sentences, lengths, np.array(words), np.array(of_word), np.array(feature))
    names, feature = np.unique(bags.feature, return_inverse=True)
    bags, rng = bags._replace(feature=feature), np.random.default_rng(3)
    w, bias, decay = rng.normal(size=len(names)) * 0.3, -0.7, 0.01
    total, by_weight, by_bias = toxicity.loss(bags, w, bias, decay)
    place, slow = {str(n): k for k, n in enumerate(names)}, 0.0
    for text, toxic in zip(texts, bags.label):
        none = 1.0
        for part in toxicity._SENTENCE.findall(text):
            z = bias + sum(sum(w[place[f]] for f in toxicity.parts(word)) for word in dict.fromkeys(part.split()))
            none *= 1 - 1 / (1 + np.exp(-z))
        slow -= np.log(1 - none if toxic else none) / len(texts)
    assert abs(total - slow - decay / 2 * (w @ w)) < 1e-9
    for k in range(0, len(w), 3):
        up, down = w.copy(), w.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((toxicity.loss(bags, up, bias, decay)[0] - toxicity.loss(bags, down, bias, decay)[0]) / 2e-5 - by_weight[k]) < 1e-6
    assert abs((toxicity.loss(bags, w, bias + 1e-5, decay)[0] - toxicity.loss(bags, w, bias - 1e-5, decay)[0]) / 2e-5 - by_bias) < 1e-6


def test_learning_rows_are_bounded(spark):
    frame = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(7, "other")] * 30 + [(None, "x")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("at", "version", "of", "label")})
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    count = lambda rows, chars: quality.learning_rows(frame, labels, "doc_id", "text", "toxic", rows, chars).count()
    assert count(1000, 10**6) == 51 and count(20, 10**6) <= 20 and 9 <= count(1000, 1000) <= 11


@pytest.mark.parametrize("operator", [bpe.encode, token_counts.count_tokens])
def test_tokenisers_on_tables_without_rows_and_taken_names(spark, operator):
    path = BYTE if operator is bpe.encode else WORD
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({"ids": F.lit(0), "n_tokens": F.lit(1)})
    assert operator(frame.limit(0), path, carry=["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="taken"):
        operator(frame, path)
    for scored in (quality, toxicity):
        with pytest.raises(ValueError, match="taken"):
            scored.score(frame.withColumn("score", F.lit(1)), scored.train(frame, frame.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))))


def test_every_text_goes_through_chunk_maps(word):
    own = token_counts.load(WORD)
    for text in ("a b", "It's 12 o'clock, isn't it? " * 400, "x" * 9000, "don" + "'t " * 3):
        for chunk in (1, 3, 7, 4096):
            counts = own.chunk_counts(token_counts.normalise(text), chunk)
            assert len(counts) == -(-len(text) // chunk) and sum(counts) == len(ids(word[1], text))


def test_a_cut_that_ends_in_token_zero_is_no_end():
    packer = packing.DocumentPacker(tokens=8, segments=4, loss=7, pool=16)
    found = []
    for i in range(12):
        found += packer.add(i, np.zeros(13, dtype="<u4"))
    found += packer.finish()
    loss = {}
    for (_, at, part, total), sequence, _ in found:
        loss[sequence] = loss.get(sequence, 0) + len(part) - (at + len(part) == total)
    assert max(loss.values()) <= 7 and sum(len(p[2]) for p, _, _ in found) == 12 * 13
