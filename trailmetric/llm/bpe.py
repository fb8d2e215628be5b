"""Byte-level BPE encoding and decoding (operator 2).

Encoding: a word's bytes form a doubly linked symbol list; a heap holds the merge
rank of every adjacent pair, and a popped entry whose pair has changed since it was
pushed is stale and skipped.  Decoding concatenates the vocabulary's byte strings.

Words repeat, so ids are memoised by white-space piece; the memo is bounded and a
miss only costs the merge loop again.  State per worker: vocabulary plus memo.

Defined results: null and empty texts give no ids and decode to ''; an id outside
the vocabulary adds nothing, as a null id does; null id lists decode to ''; texts of any
length are encoded whole; rows are independent, so repeated ones give the same result each
and a null id is carried; an empty table gives no rows; a carried column of the result's
name raises ValueError, other columns are carried or left as the caller says.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import local, ship, shipped

MEMO_ENTRIES = 250_000
MEMO_PIECE_CHARS = 80
ROWS_AT_ONCE = 512

# White space of the split pattern (Unicode White_Space).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WS_CHARS = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_PIECE = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge rules: ``rank[left][right]``, and ``made`` by rank."""

    def __init__(self, vocab: dict[str, int], rules: list):
        pairs = [r.split(" ") if isinstance(r, str) else r for r in rules]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for k, (a, b) in enumerate(pairs):
            self.rank[vocab[a]].setdefault(vocab[b], k)


def merge_symbols(symbols: list[int], merges: Merges) -> list[int]:
    """Apply merges to the list, in place: lowest rank first and leftmost among equals, until none is left.

    A heap entry is the rank above ``bits`` bits for the position of the pair's left symbol.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank, made_by, bits = merges.rank, merges.made, 8 if n <= 256 else 40
    heap, left = [], symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if right in (rules := rank[left]):
            heap.append(rules[right] << bits | i - 1)
        left = right
    if not heap:
        return symbols
    heapq.heapify(heap)
    pop, push, place = heapq.heappop, heapq.heappush, (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = pop(heap)
        i = entry & place
        if (left := symbols[i]) < 0 or (j := after[i]) >= n:
            continue
        k = entry >> bits
        if rank[left].get(symbols[j]) != k:
            continue  # stale: one side has been merged since
        symbols[i] = made = made_by[k]
        symbols[j] = -1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (right := symbols[j]) in (rules := rank[made]):
                push(heap, rules[right] << bits | i)
        if (h := before[i]) >= 0 and made in (rules := rank[symbols[h]]):
            push(heap, rules[made] << bits | h)
    return [s for s in symbols if s >= 0]


def single_spaced(text: str) -> bool:
    """Whether no two white-space characters are neighbours."""
    if "  " in text:
        return False
    found = [c for c in _WS_CHARS[: 6 if text.isascii() else None] if c in text]
    return not any(a + b in text for a in found for b in found)


class Memo(dict):
    """A bounded memo of ``make``: what the last two generations of ``MEMO_ENTRIES`` keys asked for is kept.

    A hit is a plain dictionary lookup.
    """

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_PIECE_CHARS:
                return value
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self._byte_ids = [vocab[alphabet[b]] for b in range(256)]
        self._merges = Merges(vocab, model["merges"])
        # Ids are kept as packed int32: by word of the split pattern, and by piece with or without a space before it.
        self._words = Memo(self._word)
        self._plain = Memo(lambda piece: self._piece(piece, "", self._plain))
        self._spaced = Memo(lambda piece: self._piece(piece, " ", self._spaced))

    def _word(self, word: str) -> bytes:
        ids = merge_symbols([self._byte_ids[b] for b in word.encode()], self._merges)
        return array("i", ids).tobytes()

    def _piece(self, piece: str, lead: str, memo: Memo) -> bytes:
        if piece.isalpha():
            return self._word(lead + piece)
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return memo[piece[:-1]] + self._words[piece[-1]]
        return b"".join(map(self._words.__getitem__, _WORD.findall(lead + piece)))

    def _plain_runs(self, text: str) -> Iterator[bytes]:
        if single_spaced(text):
            # Every white-space run is one character, so a space always belongs to what follows it.
            first, *rest = text.split(" ")
            return chain((self._plain[first],), map(self._spaced.__getitem__, rest))
        return map(self._plain.__getitem__, _PIECE.findall(text))

    def packed(self, text: str) -> bytes:
        """The ids as int32 in the machine's byte order."""
        if not any(map(text.__contains__, self.added)):
            return b"".join(self._plain_runs(text))
        out, at = [], 0
        for m in self._added.finditer(text):
            out += self._plain_runs(text[at : m.start()])
            out.append(array("i", [self.added[m[0]]]).tobytes())
            at = m.end()
        out += self._plain_runs(text[at:])
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text or "")).tolist()

    def decode(self, ids) -> str:
        known = self.bytes_of
        try:
            data = b"".join(map(known.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except (IndexError, TypeError):
            data = None
        if data is None:
            data = b"".join(known[i] for i in ids if i is not None and 0 <= i < len(known))
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_batch(bpe: ByteBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts, one after the other."""
    packed = [bpe.packed(text) if text else b"" for text in texts.to_pylist()]
    ends = np.zeros(len(packed) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
    return ends, np.frombuffer(b"".join(packed), dtype=np.int32)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _with(df: DataFrame, carry: list[str] | None, column: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    names = df.columns if carry is None else carry
    if column in names:
        raise ValueError(f"column {column!r} is taken")
    return names, T.StructType([*[df.schema[c] for c in names], T.StructField(column, kind)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``) and the token ids of ``text`` as array<int>."""
    ship(df.sparkSession)
    vocabulary = shipped(df.sparkSession, vocabulary)
    names, schema = _with(df, carry, ids, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(local(vocabulary))
        for batch in slices(batches):
            ends, flat = encode_batch(bpe, batch.column(text))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), lists], names=[*names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``) and the text of the token ids."""
    ship(df.sparkSession)
    vocabulary = shipped(df.sparkSession, vocabulary)
    names, schema = _with(df, carry, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(local(vocabulary))
        for batch in slices(batches):
            column = batch.column(ids)
            flat, ends = column.values, column.offsets.to_pylist()
            # One list for the batch; a document's ids are a slice of it.
            flat = flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()
            valid = column.is_valid().to_pylist() if column.null_count else repeat(True)
            texts = [bpe.decode(flat[a:b]) if ok else "" for a, b, ok in zip(ends, ends[1:], valid)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(texts, pa.string())], names=[*names, text])

    return df.mapInArrow(run, schema)
