"""Token counts by a finite-state tokenizer (operator 10).

The word-end BPE vocabulary is compiled, on demand, into a deterministic transducer
over characters whose transitions carry the number of tokens they emit:

* The lexer part splits a normalised text into letters, digits, punctuation and
  contractions; white space brings every state back to ``RESET``.
* The BPE part uses that a token sequence is the encoding of its bytes exactly if every
  neighbouring pair is the encoding of its own bytes.  So the encoding of a prefix is
  given by the last token at each of its ends, and a state needs them only for the
  longest suffix that some token starts with.  Counts may fall when bytes merge, so a
  transition's count is a difference; a word's are added up to its exact count.

States and transitions are interned as they are met (a lazy subset construction), and
the extended transition of a whole piece from ``RESET`` is memoised, both within bounds.
Every text is cut into chunks. A chunk's state map is constant after its first white space;
up to there it is a table by the state that the chunk is entered in, whose entries are made
when a state turns up.  Maps compose associatively, into tables of their own: a prefix scan,
whose rounds hold only independent compositions, gives the state that every chunk is entered
in; each chunk then emits its own count, and a text's count is their sum.  As the states
that turn up are those of the text itself, a character is advanced once or twice, whether or
not the text has white space.

Defined results: null and empty texts have 0 bytes and 0 tokens, blanks have no token; texts
of any length are read whole; every row counts, whether or not its id or text repeats or its
id is null; an empty table gives no rows; a carried column named n_bytes or n_tokens raises
ValueError, other columns are carried or left as the caller says.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import WS, Memo, Merges, byte_alphabet, merge_symbols, slices
from .common import local, ship, shipped

CHUNK_CHARS = 1 << 12
MAX_STATES = 120_000
PAIR_ENTRIES = 500_000

RESET = 0
_SPACE = re.compile(f"[{WS}]")
_WS_RUN = re.compile(f"[{WS}]+")
_ODD_WS = re.compile("[\x1c-\x1f]")  # white space to str.split() only
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Letters newer than Python's tables and their lower case.
_NEW_LOWER = {0xA7CB: 0x0264, 0xA7DC: 0x019B}
#: The contractions of the split pattern, after their quote.
_SHORT, _LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


def _kind(ch: str) -> tuple[bool, bool]:
    """(letter, number). The newer tables of the two hold below plane 3, above it the standard library's are right."""
    if ord(ch) < 0x30000:
        return bool(_LETTER.match(ch)), bool(_NUMBER.match(ch))
    return (kind := unicodedata.category(ch)[0]) == "L", kind == "N"


class WordBpe:
    """The vocabulary: merges over byte symbols, the last one of a word marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.added = spec["model"], [t["content"] for t in spec["added_tokens"]]
        end = model["end_of_word_suffix"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.merges = Merges(vocab, model["merges"])
        self.inner = [vocab[alphabet[b]] for b in range(256)]
        self.final = [vocab[alphabet[b] + end] for b in range(256)]
        self.bytes_of: dict[int, bytes] = {}
        self.inner_token: dict[bytes, int] = {}
        self.final_token: dict[bytes, int] = {}
        for token, i in vocab.items():
            last = token.endswith(end)
            data = bytes(back[c] for c in (token[: -len(end)] if last else token))
            # A token that its own bytes don't merge to never occurs.
            if self.encode(data, last) == [i]:
                self.bytes_of[i] = data
                (self.final_token if last else self.inner_token)[data] = i
        self.longest = max(map(len, self.bytes_of.values()))
        self.prefixes = {d[:k] for d in self.bytes_of.values() for k in range(1, len(d))}
        self._pairs: dict[tuple[int, int], bool] = {}

    def encode(self, data: bytes, last: bool) -> list[int]:
        symbols = [self.inner[b] for b in data]
        if last:
            symbols[-1] = self.final[data[-1]]
        return merge_symbols(symbols, self.merges)

    def stands(self, left: int | None, token: int, last: bool) -> bool:
        """Whether ``token`` may follow ``left`` in an encoding."""
        if left is None:
            return True
        key = (left, token)
        if (ok := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            ok = self._pairs[key] = self.encode(self.bytes_of[left] + self.bytes_of[token], last) == [left, token]
        return ok


class Open(NamedTuple):
    """Inside a word: ``suffix`` may start a token; ``ends[j]`` is (last token, tokens beyond the final end) at its j-th end, None if no token goes on from there."""

    suffix: bytes
    ends: tuple[tuple[int | None, int] | None, ...]


_START = Open(b"", ((None, 0),))


class State(NamedTuple):
    """Lexer mode, BPE state and the byte that is known not to be used yet (it may be a word's last)."""

    mode: str  # "": between words, L: letters, P: punctuation, Q: a quote that opens a word, r v l: after such a quote
    bpe: Open
    pending: int


class Transducer:
    """advance(state, character) -> (state, tokens emitted); ``close`` gives what a state emits at white space."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.states: list[State] = [State("", _START, -1)]
        self.ids: dict[State, int] = {self.states[0]: RESET}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.closes: dict[int, int] = {RESET: 0}
        self.pieces = Memo(self._piece)

    # -- BPE ---------------------------------------------------------------
    def _candidates(self, at: Open, byte: int, last: bool) -> tuple[bytes, int, int]:
        """(bytes since the suffix began, last token, its count beyond the previous end) after ``byte``."""
        text, tokens = at.suffix + bytes([byte]), self.bpe.final_token if last else self.bpe.inner_token
        for k in range(len(text)):
            token = tokens.get(text[k:])
            if token is not None and at.ends[k] and self.bpe.stands(at.ends[k][0], token, last):
                return text, token, at.ends[k][1] + 1
        raise AssertionError("every prefix has an encoding")

    def _feed(self, at: Open, byte: int) -> tuple[Open, int]:
        text, token, delta = self._candidates(at, byte, last=False)
        ends = [*at.ends, (token, delta)]
        k = next(k for k in range(len(text) + 1) if text[k:] in self.bpe.prefixes or k == len(text))
        # Ends that no token can go on from don't tell states apart.
        live = ((end[0], end[1] - delta) if j == len(text) or text[j:] in self.bpe.prefixes else None for j, end in enumerate(ends[k:], k))
        return Open(text[k:], tuple(live)), delta

    def _finish(self, at: Open, byte: int) -> int:
        return self._candidates(at, byte, last=True)[2]

    # -- lexer -------------------------------------------------------------
    def _word(self, word: str) -> int:
        """Tokens of a word that the lexer has seen the end of."""
        state, n = self.states[RESET], 0
        for ch in word:
            state, d = self._take(state, ch, "P")
            n += d
        return n + self._finish(state.bpe, state.pending)

    def _take(self, s: State, ch: str, mode: str) -> tuple[State, int]:
        bpe, pending, n = s.bpe, s.pending, 0
        for byte in ch.encode():
            if pending >= 0:
                bpe, d = self._feed(bpe, pending)
                n += d
            pending = byte
        return State(mode, bpe, pending), n

    def _ended(self, s: State) -> int:
        if s.mode in ("L", "P"):
            return self._finish(s.bpe, s.pending)
        return {"": 0, "Q": 1}.get(s.mode) if s.mode in ("", "Q") else 1 + self._word(s.mode)

    def _next(self, s: State, ch: str) -> tuple[State, int]:
        fresh = self.states[RESET]
        if _SPACE.match(ch):
            return fresh, self._ended(s)
        letter, number = _kind(ch)
        if s.mode == "Q":
            if ch in _SHORT:
                return fresh, self._word("'" + ch)
            if ch in _LONG:
                return State(ch, _START, -1), 0
            return self._next(self._take(fresh, "'", "P")[0], ch)
        if s.mode in _LONG:
            if ch == _LONG[s.mode]:
                return fresh, self._word("'" + s.mode + ch)
            after, n = self._next(self._take(fresh, s.mode, "L")[0], ch)
            return after, n + self._word("'")
        if s.mode == "L" and letter or s.mode == "P" and not letter and not number:
            return self._take(s, ch, s.mode)
        done = self._ended(s)
        if number:
            return fresh, done + self._word(ch)
        if ch == "'":
            return State("Q", _START, -1), done
        after, n = self._take(fresh, ch, "L" if letter else "P")
        return after, done + n

    # -- compiled machine ----------------------------------------------------
    def _intern(self, s: State) -> int | State:
        """The state's number; the state itself once MAX_STATES are compiled."""
        if (i := self.ids.get(s)) is None:
            if (i := len(self.states)) >= MAX_STATES:
                return s
            self.ids[s] = i
            self.states.append(s)
            self.moves.append({})
        return i

    def advance(self, state: int | State, text: str) -> tuple[int | State, int]:
        """The state after ``text`` and the tokens emitted on the way."""
        n, moves = 0, self.moves
        for ch in text:
            try:
                state, d = moves[state][ch]
            except (KeyError, TypeError):  # not compiled yet, or not to be
                after, d = self._next(state if isinstance(state, State) else self.states[state], ch)
                to = self._intern(after)
                if isinstance(state, int) and isinstance(to, int):
                    moves[state][ch] = to, d
                state = to
            n += d
        return state, n

    def close(self, state: int | State) -> int:
        if isinstance(state, State):
            return self._ended(state)
        if (n := self.closes.get(state)) is None:
            n = self.closes[state] = self._ended(self.states[state])
        return n

    def _piece(self, piece: str) -> int:
        """Tokens of a piece without white space: the extended transition from RESET back to RESET."""
        state, n = self.advance(RESET, piece)
        return n + self.close(state)

    # -- texts ---------------------------------------------------------------
    def _map(self, chunk: str) -> ChunkMap:
        if not _SPACE.search(chunk):
            return ChunkMap(lambda state: self._ran(state, chunk), None)
        pieces = _WS_RUN.split(chunk) if _ODD_WS.search(chunk) else None
        if pieces is None:
            pieces = chunk.split()
            pieces = [""] * bool(_SPACE.match(chunk[0])) + pieces + [""] * bool(_SPACE.match(chunk[-1]))
            if len(pieces) < 2:
                pieces = ["", ""]
        end, n = self.advance(RESET, pieces[-1])
        n += sum(map(self.pieces.__getitem__, pieces[1:-1]))
        head = pieces[0]

        def run(state: int | State) -> tuple[int, int | State]:
            before, state = self._ran(state, head)
            return before + self.close(state) + n, end

        return ChunkMap(run, (n, end))

    def _ran(self, state: int | State, text: str) -> tuple[int, int | State]:
        state, n = self.advance(state, text)
        return n, state

    def chunk_counts(self, text: str, chunk: int = CHUNK_CHARS) -> list[int]:
        """Tokens by chunk of a normalised text without special strings; what a chunk leaves open counts for the one that ends it."""
        maps = [self._map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        entered = [(0, RESET), *(m(RESET) for m in scan(maps, compose))]
        # The scan's prefixes count all that was emitted before a chunk and give the state it is entered in.
        counts = [after[0] - before[0] for before, after in zip(entered, entered[1:])]
        if counts:
            counts[-1] += self.close(entered[-1][1])
        return counts

    def count(self, text: str | None, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        parts = [text]
        for special in self.bpe.added:
            if special in text:
                parts = [q for p in parts for q in p.split(special)]
        return len(parts) - 1 + sum(sum(self.chunk_counts(normalise(part), chunk)) for part in parts)


class ChunkMap:
    """The effect of a stretch of text: entry state -> (tokens emitted, state), a table filled by ``run``.

    ``after`` is (tokens, state) from the stretch's first white space on, whatever state it is entered in, None without one.
    """

    __slots__ = ("run", "after", "table")

    def __init__(self, run: Callable[[int | State], tuple[int, int | State]], after: tuple[int, int | State] | None):
        self.run, self.after, self.table = run, after, {}

    def __call__(self, state: int | State) -> tuple[int, int | State]:
        if (found := self.table.get(state)) is None:
            found = self.table[state] = self.run(state)
        return found


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of ``a`` and then ``b``; what follows white space in ``a`` is known at once."""

    def run(state: int | State) -> tuple[int, int | State]:
        n, state = a(state)
        more, state = b(state)
        return n + more, state

    if a.after is None:
        return ChunkMap(run, b.after)
    n, state = a.after
    more, state = b(state)
    return ChunkMap(run, (n + more, state))


def scan(items: list, compose) -> list:
    """Inclusive prefix scan: an up-sweep and a down-sweep of rounds whose compositions don't depend on each other."""
    out, n, width = list(items), len(items), 1
    while width < n:
        for i in range(2 * width - 1, n, 2 * width):
            out[i] = compose(out[i - width], out[i])
        width *= 2
    while width > 1:
        half = width // 2
        for i in range(width + half - 1, n, width):
            out[i] = compose(out[i - half], out[i])
        width = half
    return out


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no final sigma); white space is left as it is."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        if "\ua7cb" in text or "\ua7dc" in text:
            text = text.translate(_NEW_LOWER)
    return text.lower()


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``), n_bytes (UTF-8) and n_tokens of ``text``."""
    ship(df.sparkSession)
    vocabulary = shipped(df.sparkSession, vocabulary)
    names = df.columns if carry is None else carry
    if {"n_bytes", "n_tokens"} & set(names):
        raise ValueError("columns n_bytes and n_tokens are taken")
    long = T.LongType()
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("n_bytes", long), T.StructField("n_tokens", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(local(vocabulary))
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in (t or "" for t in texts)]
            counts = [pa.array(n_bytes, pa.int64()), pa.array(map(machine.count, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *counts], names=[*names, "n_bytes", "n_tokens"])

    return df.mapInArrow(run, schema)
