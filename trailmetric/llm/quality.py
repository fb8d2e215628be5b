"""Quality classifier: naive Bayes support vectors (operator 4).

Features are indicators of n-grams (1 to 3) over the words in lower case and over the words'
shapes, where a shape keeps punctuation, folds runs of letters by case and digits, and says
whether the word repeats one of the three before it.  Each indicator is scaled by the log
ratio of its smoothed class frequencies, and a linear hinge-loss model is fitted to the
scaled indicators by dual coordinate descent; a logistic curve fitted on rows that the model
did not see turns margins into scores.

Learning takes a sample of labelled rows in the order of a hash of their ids, bounded by
``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters; features are made on the executors, and
only their numbers come to the driver.  Scoring reads every row's whole text in one pass
without a shuffle.

Defined results: null and empty texts have no n-gram and get the model's score for that;
rows with a null label or id are not learnt from; of a row labelled twice the larger label
counts; rows alike in id and text are learnt from once and each scored; without both classes
every score is the smoothed share of label 1 (a half without any); a null id is carried; an
empty table gives no rows; a carried column named score raises ValueError, other columns are
carried or left as the caller says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, slices
from .common import ship

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 1 << 24
BUCKETS = 1 << 18
LAGS = 3
_OUTER = re.compile(r"^\W+|\W+$")
_FOLD = ((re.compile(r"[^\W\d_]+"), lambda m: ("A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a")), (re.compile(r"\d+"), lambda m: "0"))


def shape(word: str) -> str:
    for pattern, fold in _FOLD:
        word = pattern.sub(fold, word)
    return word


def _word_codes(word: str) -> tuple[int, int, int]:
    """Positive int64 hashes of the word, of its shape and of its lower case without outer punctuation."""
    code = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1
    return code(word), code(shape(word)), code(_OUTER.sub("", word).lower())


@lru_cache(maxsize=1)
def _codes() -> Memo:
    return Memo(_word_codes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct feature of every text, ordered by row."""
    codes, flat, lengths = _codes(), [], []
    for text in texts:
        words = text.split() if text else []
        flat += map(codes.__getitem__, words)
        lengths.append(len(words))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = np.array(flat, dtype=np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    word, shapes, plain = parts.T
    repeats = np.zeros(len(word), dtype=bool)
    for lag in range(1, LAGS + 1):
        repeats[lag:] |= (word[lag:] == word[:-lag]) & (row[lag:] == row[:-lag])
    keys = []
    for unit in (_mixed(shapes * np.uint64(2) + repeats), _mixed(~plain)):
        gram = unit
        for n in range(1, 4):
            if n > 1:
                gram = _mixed(gram[:-1] * np.uint64(31) + unit[n - 1 :])
            same = row[: len(gram)] == row[n - 1 :]
            keys.append((row[: len(gram)][same] << np.uint64(32)) | (gram[same] % np.uint64(buckets)))
    found = pd.unique(np.concatenate(keys))
    found = found[np.argsort(found >> np.uint64(32), kind="stable")]
    return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Model(NamedTuple):
    """score = 1 / (1 + exp(-(slope * margin + shift)))"""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row, self.weights[feature], rows) + self.bias

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return sigmoid(self.slope * self.margins(row, feature, rows) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_ratios(row: np.ndarray, feature: np.ndarray, label: np.ndarray, buckets: int, smooth: float = 1.0) -> np.ndarray:
    on = label[row] == 1
    p = smooth + np.bincount(feature[on], minlength=buckets)
    q = smooth + np.bincount(feature[~on], minlength=buckets)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(row, feature, value, label, buckets: int, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear hinge-loss model; a class's rows cost in inverse proportion to their number."""
    n, y = len(label), np.where(label == 1, 1.0, -1.0)
    ends = np.searchsorted(row, np.arange(n + 1))
    cols = [feature[a:b] for a, b in zip(ends, ends[1:])]
    vals = [value[a:b] for a, b in zip(ends, ends[1:])]
    norm = np.array([v @ v + 1.0 for v in vals])
    share = np.bincount((label == 1).astype(int), minlength=2) / n
    upper = cost * np.where(label == 1, 0.5 / share[1], 0.5 / share[0])
    alpha, w, bias = np.zeros(n), np.zeros(buckets), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            c, v = cols[i], vals[i]
            gradient = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[c] += step * y[i] * v
                bias += step * y[i]
                worst = max(worst, abs(step) * norm[i])
        if worst < 1e-3:
            break
    return w, bias


def fit_curve(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, shift) of the logistic curve, by Newton's method towards smoothed targets."""
    n1 = label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * beta)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, buckets: int = BUCKETS) -> Model:
    """The model of (row, feature) indicators and the rows' labels 0 and 1."""
    n = len(label)
    if len(np.unique(label)) < 2:
        share = (label.sum() + 1) / (n + 2)
        return Model(np.zeros(buckets), 0.0, 0.0, float(np.log(share / (1 - share))))

    def learn(rows: np.ndarray) -> tuple[np.ndarray, float]:
        number = np.full(n, -1, dtype=np.int32)
        number[rows] = np.arange(len(rows))
        r = number[row]
        mine = r >= 0
        r, f, y = r[mine], feature[mine], label[rows]
        ratio = log_ratios(r, f, y, buckets)
        w, bias = dual_coordinate_descent(r, f, ratio.astype(np.float32)[f], y, buckets)
        return w * ratio, bias

    # Margins of rows that were not learnt from, in turn, give the curve; all rows give the weights.
    fold, seen = np.arange(n) % 3, []
    for k in range(3):
        rest = np.flatnonzero(fold != k)
        if len(np.unique(label[rest])) < 2:
            continue
        w, bias = learn(rest)
        out = fold[row] == k
        margin = np.bincount(row[out], w[feature[out]], n)[fold == k] + bias
        seen.append((margin, label[fold == k]))
    w, bias = learn(np.arange(n))
    margin, truth = map(np.concatenate, zip(*seen)) if seen else (np.bincount(row, w[feature], n) + bias, label)
    return Model(w, bias, *fit_curve(margin, truth))


def sample(labels: DataFrame, doc_id: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, in the order of a hash: (doc_id, label). Its size is bounded, so it may be broadcast."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    return known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learning_rows(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int, chars: int) -> DataFrame:
    """(at, version, text, label) of the labelled rows to learn from: at most ``rows``, and none after ``chars`` characters, in the order of (at, version)."""
    known = sample(labels, doc_id, label, rows).withColumnRenamed("doc_id", "of")
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("of"))
    own = own.select(F.xxhash64("doc_id").alias("at"), F.xxhash64("text").alias("version"), "text", "label")
    # The bounds are set on lengths; only rows within them send more than that.
    sizes = own.select("at", "version", F.coalesce(F.length("text"), F.lit(0)).alias("size")).distinct().orderBy("at", "version").limit(rows)
    before = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("at", "version").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.withColumn("before", before).filter(F.col("before") < chars).select("at", "version")
    return own.join(F.broadcast(chosen), ["at", "version"]).dropDuplicates(["at", "version"])


def train(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, buckets: int = BUCKETS
) -> Model:
    """Fit on a sample of ``labels`` bounded by ``rows`` and ``chars``; the caller leaves out the rows that must not be learnt from."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = batch.column("text").to_pylist()
            row, feature = features(texts, buckets)
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("at", "version", "label")), lists], names=["at", "version", "label", "features"])

    kinds = pa.schema([("weights", pa.list_(pa.float64())), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            model = fit_table(pa.Table.from_batches(held), buckets)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(model, kinds.types, strict=True)], schema=kinds)

    learn = learning_rows(df, labels, doc_id, text, label, rows, chars)
    # The sample's features, a few to a word, are bounded by ``rows`` and ``chars``: one task of an executor fits them, and
    # only the weights come to the driver.
    found = learn.mapInArrow(run, "at long, version long, label int, features array<int>")
    model = found.repartition(1).mapInArrow(fitted, "weights array<double>, bias double, slope double, shift double").toArrow()
    if not model.num_rows:
        return fit(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int8), buckets)
    weights = np.array(model["weights"].combine_chunks().flatten())
    return Model(weights, *[float(model[c][0].as_py()) for c in ("bias", "slope", "shift")])


def fit_table(found: pa.Table, buckets: int) -> Model:
    """The model of rows (at, version, label, features), in the order of (at, version) wherever they come from."""
    found = found.sort_by([("at", "ascending"), ("version", "ascending")]).combine_chunks()
    # Small numbers in small types: a few of these arrays are held at a time.
    label_of, lists = found["label"].to_numpy().astype(np.int8), found["features"].combine_chunks()
    lengths, feature = np.asarray(lists.value_lengths()), np.array(lists.flatten())
    del found, lists
    return fit(np.repeat(np.arange(len(label_of), dtype=np.int32), lengths), feature, label_of, buckets)


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``) and ``score``: the probability of label 1."""
    spark = df.sparkSession
    ship(spark)
    names = df.columns if carry is None else carry
    if "score" in names:
        raise ValueError("column 'score' is taken")
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(tuple(model))  # BUCKETS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in slices(batches, 128):
            row, feature = features(batch.column(text).to_pylist(), len(model.weights))
            scores = pa.array(model.scores(row, feature, batch.num_rows), pa.float64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), scores], names=[*names, "score"])

    return df.mapInArrow(run, schema)
