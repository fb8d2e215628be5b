"""Packing of token sequences by vector bin packing (operator 6).

Examples have a demand of several resources at once (tokens, segments, loss-bearing
tokens) and a sequence has a limit on each.  The sequence being filled takes, of the
examples in reach, the one whose demand has the largest dot product with what is left
of the limits, both as shares of the limits.

``pack_documents`` tokenises documents, ends each with id 0 and may cut: whole sequences
of a long document stand alone, the rest of it goes into the pool.  A gap that nothing
fits is filled with a cut of the largest example, so only a sequence that runs out of
segments is padded; what is left at a partition's end goes into sequences whose lengths
are powers of two.  ``pack_examples`` never cuts.

Each partition packs its own rows in one pass with a bounded pool: no shuffle, and a
lost partition is made again from its input.  Sequence ids hold the partition's number.

Of a document's tokens all but its end id bear loss, so the default limit of loss-bearing
tokens (that of all tokens) binds only if it is set lower, which trades padding for it;
examples with a loss count of their own go to ``pack_examples``.

Defined results: a null or empty text has only its end id; a long text is cut into as many
pieces as it needs; of slots that fit equally well the first is taken; an example beyond a
limit raises in ``pack_examples``; rows with a null demand count as 0 of it; a null id is
carried; repeated rows and ids are packed as separate documents; empty input packs to no
rows; of the caller's columns only those named are read, so others may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_alphabet, slices
from .common import local, ship, shipped

POOL = 1024
PARTITION_SHIFT = 40  # sequence_id = partition << 40 | number within it
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the vocabulary's split pattern


class Ids:
    """Token ids of whole texts; special strings become their ids, as in the vocabulary's own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, end: int) -> np.ndarray:
        runs = []
        for run in self._cut.split(text) if any(map(text.__contains__, self.special)) else [text]:
            runs.append([self.special[run]] if run in self.special else self._plain.encode_to_numpy(run, disallowed_special=()))
        return np.concatenate([*runs, [end]]).astype("<u4")


@lru_cache(maxsize=2)
def load(path: str) -> Ids:
    return Ids(path)


class Pool:
    """Examples in reach of the sequence being filled, in ``size`` slots; what they are is the caller's affair."""

    def __init__(self, limits: tuple[int, ...], size: int = POOL):
        self.limits = np.array(limits, dtype=np.float64)
        self.demand = np.full((len(limits), size), np.inf)
        self.weighted = np.zeros((len(limits), size))  # demand as a share of the limits, twice
        self.held: list = [None] * size
        self.free = list(range(size))[::-1]

    def __len__(self) -> int:
        return len(self.held) - len(self.free)

    def put(self, demand, what) -> None:
        k = self.free.pop()
        self.demand[:, k] = demand
        self.weighted[:, k] = self.demand[:, k] / self.limits**2
        self.held[k] = what

    def take(self, k: int):
        what, self.held[k] = self.held[k], None
        self.demand[:, k] = np.inf
        self.weighted[:, k] = 0
        self.free.append(k)
        return what

    def best(self, left: np.ndarray) -> int | None:
        """The slot that fits ``left`` with the largest dot product; the first of equals."""
        fits = (self.demand <= left[:, None]).all(axis=0)
        score = np.where(fits, left @ self.weighted, -1.0)
        k = int(score.argmax())
        return k if fits[k] else None

    def largest(self, resource: int = 0) -> int:
        return int(np.where(np.isfinite(self.demand[resource]), self.demand[resource], -1).argmax())


class DocumentPacker:
    """Packs token arrays, cutting them freely. Yields (piece, sequence number, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = POOL):
        self.tokens = tokens
        self.pool = Pool((tokens, segments, loss), pool)
        self.sequences = 0

    @staticmethod
    def _demand(ids: np.ndarray, closes: bool) -> tuple[int, int, int]:
        """All tokens bear loss but the end id, which only a document's last piece has."""
        return len(ids), 1, len(ids) - int(closes)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while total - at >= self.tokens and self.tokens - (total - at == self.tokens) <= self.pool.limits[2]:
            yield from self._sequence([(doc, at, ids[at : at + self.tokens], total)])
            at += self.tokens
        if at == total:
            return
        if not self.pool.free:
            while len(self.pool) > len(self.pool.held) // 2:
                yield from self._sequence(self._fill())
        self.pool.put(self._demand(ids[at:], True), (doc, at, ids[at:], total))

    def finish(self) -> Iterator[tuple]:
        while len(self.pool):
            yield from self._close(self._fill())

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield piece, self.sequences, offset
            offset += len(piece[2])
        self.sequences += 1

    def _fill(self) -> list[tuple]:
        left, pieces = self.pool.limits.copy(), []
        while len(self.pool) and left[0] > 0 and left[1] > 0 and left[2] > 0:
            k = self.pool.best(left)
            # The last segment, or a gap that nothing fits, takes a cut if one can fill it.
            if k is None or left[1] == 1:
                big = self.pool.largest()
                doc, at, ids, total = self.pool.held[big]
                n = int(min(left[0], left[2]))
                if len(ids) > n:
                    self.pool.take(big)
                    self.pool.put(self._demand(ids[n:], True), (doc, at + n, ids[n:], total))
                    pieces.append((doc, at, ids[:n], total))
                    left -= self._demand(ids[:n], False)
                    continue
            if k is None:
                break
            pieces.append(self.pool.take(k))
            left -= self._demand(pieces[-1][2], True)
        return pieces

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The pieces as sequences of a power of two each, if they are all that is left."""
        n = sum(len(p[2]) for p in pieces)
        if len(self.pool) or n == self.tokens:
            yield from self._sequence(pieces)
            return
        size = 1 << n.bit_length()
        while pieces:
            while size > n:
                size >>= 1
            part, room, rest = [], size, []
            for doc, at, ids, total in pieces:
                if room:
                    part.append((doc, at, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, at + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self._sequence(part)
            pieces, n = rest, n - size


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    tokens: int = 1024,
    segments: int = 64,
    loss: int = 1024,
    end: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    ship(df.sparkSession)
    vocabulary = shipped(df.sparkSession, vocabulary)
    kind = df.schema[doc_id].dataType
    long = T.LongType()
    fields = [("doc_id", kind), ("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)]
    schema = T.StructType([T.StructField(n, k) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = load(local(vocabulary)), DocumentPacker(tokens, segments, loss)
        base = TaskContext.get().partitionId() << PARTITION_SHIFT
        doc_type = None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((d, at, len(x), x.tobytes(), total, base | s, o) for (d, at, x, total), s, o in found))
            kinds = [doc_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for part in slices(batches):
            doc_type, found = part.schema.field(doc_id).type, []
            for d, t in zip(part.column(doc_id).to_pylist(), part.column(text).to_pylist()):
                found += packer.add(d, ids.encode(t or "", end))
            if found:
                yield batch(found)
        if found := list(packer.finish()):
            yield batch(found)

    return df.select(doc_id, text).mapInArrow(run, schema)


def pack_examples(df: DataFrame, example_id: str, demands: list[str], limits: tuple[int, ...], pool: int = POOL) -> DataFrame:
    """Whole examples under simultaneous limits: example_id, sequence_id and position within the sequence."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("example_id", df.schema[example_id].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("position", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequences, reach = TaskContext.get().partitionId() << PARTITION_SHIFT, 0, Pool(limits, pool)
        id_type = None

        def fill() -> list[tuple]:
            nonlocal sequences
            left, rows = reach.limits.copy(), []
            while (k := reach.best(left)) is not None:
                left -= reach.demand[:, k]
                rows.append((reach.take(k), base | sequences, len(rows)))
            sequences += 1
            return rows

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (id_type, pa.int64(), pa.int32()))], names=schema.names)

        for part in batches:
            id_type, rows = part.schema.field(example_id).type, []
            for e, *need in zip(*(part.column(c).to_pylist() for c in (example_id, *demands))):
                need = [n or 0 for n in need]
                if any(n > m for n, m in zip(need, limits)):
                    raise ValueError(f"example {e!r} needs {need} of {limits}")
                while not reach.free:
                    rows += fill()
                reach.put(need, e)
            if rows:
                yield batch(rows)
        rows = []
        while len(reach):
            rows += fill()
        if rows:
            yield batch(rows)

    return df.select(example_id, *demands).mapInArrow(run, schema)
