"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences and its label says only that some sentence offends.  A
sentence's probability is logistic in its distinct words' weights, and a document's is the
noisy-or of its sentences', 1 - prod(1 - p).  Weights are trained from document labels
alone, by gradient descent on the documents' log loss; the sentences' own probabilities
then locate what offends.  A word's weight is the sum of its features': itself and its
character n-grams; they may raise or lower a sentence's probability.

Learning takes a sample of labelled rows in the order of a hash of their ids, bounded by
``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters.  A feature takes part if ``LEAST``
documents hold it and the share of toxic ones among them is ``EVIDENCE`` standard deviations
above or below that of all (parameters of ``train``).  Features are made, counted and chosen on
the executors; the chosen ones and their numbers in the sample come to the driver.  Scoring reads every row's
whole text in one pass without a shuffle.

Defined results: null and empty texts have no sentence and score 0; rows with a null
label or id are not learnt from; of a row labelled twice the larger label counts; rows alike
in id and text are learnt from once and each scored; without both classes every sentence has
a probability near 0 or 1; texts of any length are read whole; a null id is carried; an empty
table gives no rows; a carried column named score or offending raises ValueError, other
columns are carried or left as the caller says.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, slices
from .common import checkpointed, ship
from .quality import learning_rows, sigmoid

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 1 << 25
LEAST = 3
EVIDENCE = 3.0
GRAMS = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]+")
_TRIM = re.compile(r"^\W+|\W+$")


def _code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def plain(word: str) -> str:
    """A word without outer punctuation and case."""
    return _TRIM.sub("", word).lower()


def parts(word: str) -> list[str]:
    """A word's distinct features: itself and its character n-grams, without outer punctuation and case; none if nothing is left."""
    if not (word := plain(word)):
        return []
    held = f"^{word}$"
    return list({held, *(held[i : i + n] for n in GRAMS for i in range(len(held) - n + 1))})


class Bags(NamedTuple):
    """Documents as bags: sentences of each document, words of each sentence (numbers), and features of each word, all laid end to end."""

    label: np.ndarray
    sentences: np.ndarray  # by document
    lengths: np.ndarray  # words, by sentence
    words: np.ndarray  # numbers
    of_word: np.ndarray  # with ``feature``: pairs
    feature: np.ndarray


class Model(NamedTuple):
    weights: dict[str, float]  # by feature
    bias: float

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(part, 0.0) for part in parts(word))


def loss(bags: Bags, w: np.ndarray, bias: float, decay: float) -> tuple[float, np.ndarray, float]:
    """Mean log loss of the noisy-or with ``decay`` / 2 times the weights' squares, its gradient by the weights and by the bias."""
    n, toxic = len(bags.label), bags.label == 1
    owner, sentence = np.repeat(np.arange(n), bags.sentences), np.repeat(np.arange(len(bags.lengths)), bags.lengths)
    n_words = int(bags.words.max(initial=-1)) + 1
    value = np.bincount(bags.of_word, w[bags.feature], n_words)
    z = bias + np.bincount(sentence, value[bags.words], len(bags.lengths))
    none = np.bincount(owner, -np.logaddexp(0, z), n)  # log of the chance that no sentence offends
    some = np.maximum(-np.expm1(none), 1e-12)
    # d loss / d z of a sentence: p in a clean document, -p (1 - P) / P in a toxic one.
    pull = np.where(toxic, -np.exp(none) / some, 1.0)[owner] * sigmoid(z) / n
    by_word = np.bincount(bags.words, pull[sentence], n_words)
    total = float(np.where(toxic, -np.log(some), -none).mean() + decay / 2 * (w @ w))
    return total, np.bincount(bags.feature, by_word[bags.of_word], len(w)) + decay * w, float(pull.sum())


def fit(bags: Bags, names: list[str], rounds: int = 300, rate: float = 0.2, decay: float = 2e-5) -> Model:
    """The model of documents' labels; a feature's number is its place in ``names``."""
    n = len(bags.label)
    if n == 0 or len(np.unique(bags.label)) < 2:
        return Model({}, 8.0 if n and bags.label.all() else -12.0)
    w, bias = np.zeros(len(names)), float(np.log((bags.label == 1).mean() / max(bags.sentences.mean(), 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        _, by_weight, by_bias = loss(bags, w, bias, decay)
        g = np.append(by_weight, by_bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 2 * (1 - k / (rounds + 1)))
        w, bias = w - step[:-1], bias - step[-1]
    return Model({name: float(x) for name, x in zip(names, w) if x}, float(bias))


def _bags(texts: list[str | None], codes) -> tuple[np.ndarray, np.ndarray, list]:
    """Sentences per text, distinct words per sentence, and what ``codes`` gives for each word."""
    sentences, words, found = [], [], []
    for text in texts:
        inside = _SENTENCE.findall(text) if text else []
        sentences.append(len(inside))
        for part in inside:
            distinct = dict.fromkeys(part.split())
            words.append(len(distinct))
            found += map(codes, distinct)
    return np.array(sentences, np.int64), np.array(words, np.int64), found


def chosen_features(learn: DataFrame, least: int, evidence: float) -> list[str]:
    """Features of the sample by how far the share of toxic documents that hold them is from that of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(parts)
        for batch in slices(batches, 32):
            found = [list({x for word in dict.fromkeys((text or "").split()) for x in memo[word]}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "features"])

    share, n = F.avg("label"), F.count(F.lit(1))
    all_ = learn.agg(share.alias("share")).first().share
    if not all_ or all_ == 1:
        return []
    each = learn.mapInArrow(run, "label int, features array<string>").select("label", F.explode("features").alias("feature"))
    distance = F.abs(share - F.lit(all_)) * F.sqrt(n) / (all_ * (1 - all_)) ** 0.5
    found = each.groupBy("feature").agg(n.alias("n"), distance.alias("distance")).filter((F.col("n") >= least) & (F.col("distance") >= evidence))
    return sorted(found.select("feature").toArrow()["feature"].to_pylist())


def train(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    least: int = LEAST,
    evidence: float = EVIDENCE,
) -> Model:
    """Fit on a sample of ``labels`` bounded by ``rows`` and ``chars``; the caller leaves out the rows that must not be learnt from."""
    ship(df.sparkSession)
    learn = checkpointed(learning_rows(df, labels, doc_id, text, label, rows, chars))
    chosen = chosen_features(learn, least, evidence)
    names = ["at", "version", "label", "lengths", "words", "counts", "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(chosen)}
        code, memo = Memo(_code), Memo(lambda word: [number[x] for x in parts(word) if x in number])
        for batch in slices(batches, 32):
            out = []
            for text_ in batch.column("text").to_pylist():
                _, lengths, words = _bags([text_], lambda word: (word, memo[word]))
                # Words without a chosen feature have no weight; the sentence stays.
                sentence = np.repeat(np.arange(len(lengths)), lengths)[[bool(found) for _, found in words]]
                held = [(code[word], found) for word, found in words if found]
                signed = np.array([c for c, _ in held], dtype=np.uint64).view(np.int64).tolist()
                out.append((np.bincount(sentence, minlength=len(lengths)).tolist(), signed, [len(found) for _, found in held], [x for _, found in held for x in found]))
            columns = [pa.array(column, pa.list_(kind)) for column, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names[:3]), *columns], names=names)

    kinds = "at long, version long, label int, lengths array<int>, words array<long>, counts array<int>, features array<int>"
    # Numbers of words with chosen features: bounded by ``chars``.
    found = learn.mapInArrow(run, kinds).toArrow().sort_by([("at", "ascending"), ("version", "ascending")])
    flat = {c: np.asarray(found[c].combine_chunks().flatten()).astype(np.int64) for c in names[3:]}
    known, first, words = np.unique(flat["words"], return_index=True, return_inverse=True)
    counts = flat["counts"][first]
    starts = (np.cumsum(flat["counts"]) - flat["counts"])[first]
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    sentences = np.asarray(found["lengths"].combine_chunks().value_lengths()).astype(np.int64)
    label_of = found["label"].to_numpy().astype(np.int64)
    return fit(Bags(label_of, sentences, flat["lengths"], words, np.repeat(np.arange(len(known)), counts), flat["features"][at]), chosen)


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, offends: float = 0.5) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``), ``score`` and ``offending``: spans and probabilities of sentences of at least ``offends``."""
    spark = df.sparkSession
    ship(spark)
    names = df.columns if carry is None else carry
    if {"score", "offending"} & set(names):
        raise ValueError("columns score and offending are taken")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    shared = spark.sparkContext.broadcast(tuple(model))  # weights of the sample's chosen features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        memo = Memo(model.of_word)
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            # A word counts once a sentence, in whichever case and with whatever punctuation it stands first.
            sentences, words, values = _bags(texts, memo.__getitem__)
            z = model.bias + np.bincount(np.repeat(np.arange(len(words)), words), np.array(values, dtype=np.float64), len(words))
            row = np.repeat(np.arange(len(texts)), sentences)
            scores = -np.expm1(np.bincount(row, -np.logaddexp(0, z), len(texts))) + 0.0
            p, first = sigmoid(z), np.concatenate([[0], np.cumsum(sentences)])
            spans: list[list] = [[] for _ in texts]
            for k in np.unique(row[p >= offends]).tolist():
                mine = p[first[k] : first[k + 1]].tolist()
                spans[k] = [{"start": m.start(), "end": m.end(), "p": q} for m, q in zip(_SENTENCE.finditer(texts[k]), mine) if q >= offends]
            added = [pa.array(np.clip(scores, 0, 1), pa.float64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *added], names=[*names, "score", "offending"])

    return df.mapInArrow(run, schema)
