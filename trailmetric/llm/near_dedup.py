"""MinHash near-dedup by a multi-index Hamming join (operator 1).

1. Each text becomes its set of distinct word shingles, a fingerprint of that set and a
   signature of ``chunks * POSITIONS`` minima of ``BITS`` bits, one 64-bit word to a chunk.
2. Texts of equal sets form a class, told by the set's 128-bit fingerprint; one row stands for it.
3. Two signatures that differ in at most ``(ERRORS + 1) * chunks - 1`` positions agree, by
   the pigeonhole principle, on some chunk but for at most ``ERRORS`` of its positions.
   Every chunk is indexed once for each choice of positions left out, so all pairs under
   that signature distance meet in a bucket.  The number of chunks is the smallest for
   which a pair at the similarity threshold exceeds the distance with a chance of at most
   ``MISS``.
4. Links are made in two rounds, so that a bucket is not expanded into all its pairs: first
   between each bucket's smallest member and the others; then, for buckets whose members are
   not yet connected, between all members of different components, each pair in the first
   bucket it shares.  A pair goes no further if its signatures are too far apart, or if the
   sets' sizes or their odd sketches (bitmaps in which every shingle flips a bit, so that they
   differ in at most as many bits as the sets do in shingles) rule out the similarity.  All
   others are confirmed on the whole shingle sets.
5. Components are found by alternating large and small stars on distributed edges.

Every cut of lineage is a reliable checkpoint.  A row that many pairs ask for goes to one task
for each ``PAIRS_AT_ONCE`` of them.  A bucket is split by bands of set sizes, as pairs of sizes
too far apart can't be similar, and a band of many members into parts, each of which meets the
band and its neighbour.

Defined results: null and empty texts, and those of blanks, have no shingle, a component of
their own and no link; a text of fewer words than a shingle is one shingle; texts of any length
are read whole; repeated rows are copies; rows that repeat an id share its links; of rows
without an id each has its own result, and their component is null unless they are linked to
a row with one; an empty table gives no rows; of the caller's columns only id and text are
read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, slices
from .common import checkpointed, ship, stored, unused, without

POSITIONS = 4
ERRORS = 1
MISS = 1e-5
BITS = 14
LANE = BITS + 1  # a spare bit, so that a sum can tell the lanes that are not 0
SKETCH_WORDS = 16
SLOT_BITS = 8
SEED = 20_240_229
PAIRS_AT_ONCE = 64
MEMBERS_AT_ONCE = 512
CHOICES = math.comb(POSITIONS, ERRORS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks_for(percent: int, miss: float = MISS) -> int:
    """The fewest chunks for which a pair of that similarity has too many differing positions with a chance of at most ``miss``."""
    differ = 1 - percent / 100
    for chunks in range(1, 64):
        n, most = chunks * POSITIONS, distance(chunks)
        if sum(math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(most + 1, n + 1)) <= miss:
            return chunks
    raise ValueError(f"no signature of a reasonable length finds pairs at {percent} %")


def distance(chunks: int) -> int:
    return (ERRORS + 1) * chunks - 1


# -- texts -----------------------------------------------------------------
@lru_cache(maxsize=1)
def _words() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z, only ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array(list(map(_words().__getitem__, words)), dtype=np.uint64)
    width = min(size, len(codes))
    out = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out * _ODD + codes[k : len(codes) - width + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, chunks: int) -> np.ndarray:
    """One 64-bit word per chunk: the low bits of its positions' (mixed) minima."""
    scale, shift = _permutations(chunks * POSITIONS)
    least = np.full(len(scale), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * scale + shift
        least = np.minimum(least, part.min(axis=0))
    low = (_mixed(least) & np.uint64((1 << BITS) - 1)).reshape(chunks, POSITIONS)
    return (low << (np.arange(POSITIONS, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64)


def odd_sketch(hashes: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """A bitmap in which every hash flips one bit."""
    bits = np.bincount((hashes >> np.uint64(20)) % np.uint64(64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def described(df: DataFrame, size: int, chunks: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets; null without shingles), the signature's chunks c0, c1, ... and the sketch s0, s1, ... of every row."""
    ship(df.sparkSession)
    names = words_of(chunks)
    fields = [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_shingles", T.LongType(), False), T.StructField("class", T.BinaryType())]
    # Never null: checks for nulls would make the code of ``possible`` several times as long.
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType(), False) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, size) for t in batch.column(text).to_pylist()]
            words = np.array([np.concatenate([signature(s, chunks), odd_sketch(s)]) for s in sets], dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [batch.column(doc_id), pa.array(map(len, sets), pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(words[:, i]) for i in range(len(names))]], names=schema.names)

    return df.select(doc_id, text).mapInArrow(run, schema)


def words_of(chunks: int) -> list[str]:
    return [*[f"c{i}" for i in range(chunks)], *[f"s{i}" for i in range(SKETCH_WORDS)]]


# -- candidates ------------------------------------------------------------
def slots(chunks: int) -> list[tuple[int, int]]:
    """(chunk, mask) of every index: each chunk without each choice of ``ERRORS`` positions."""
    found = []
    for i in range(chunks):
        for left_out in combinations(range(POSITIONS), ERRORS):
            found.append((i, lanes((1 << BITS) - 1) - sum((1 << BITS) - 1 << LANE * j for j in left_out)))
    return found


def lanes(value: int) -> int:
    """``value`` in each position of a chunk."""
    return sum(value << LANE * j for j in range(POSITIONS))


def bucket_keys(chunks: int) -> Column:
    """All bucket keys of a row; the low ``SLOT_BITS`` bits are the index's number."""
    keys = []
    for slot, (i, mask) in enumerate(slots(chunks)):
        hashed = F.xxhash64(F.lit(slot), F.col(f"c{i}").bitwiseAND(F.lit(mask)))
        keys.append(F.shiftleft(hashed, SLOT_BITS).bitwiseOR(F.lit(slot)))
    return F.array(*keys)


def differing(a: str, b: str, i: int) -> Column:
    """Positions of chunk ``i`` in which the signatures under the prefixes ``a`` and ``b`` differ.

    The sum carries into the spare bit of each lane that is not 0. Each word is named once: as expressions are trees, naming
    it again at every step made code that the JVM only interprets.
    """
    other = F.col(f"{a}c{i}").bitwiseXOR(F.col(f"{b}c{i}"))
    return F.bit_count((other + F.lit(lanes((1 << BITS) - 1))).bitwiseAND(F.lit(lanes(1 << BITS))))


def signature_distance(a: str, b: str, chunks: int) -> Column:
    """Positions in which the signatures under the prefixes ``a`` and ``b`` differ."""
    total = F.lit(0)
    for i in range(chunks):
        total = total + differing(a, b, i)
    return total


def possible(a: str, b: str, chunks: int, percent: int) -> Column:
    """Whether the sizes, the sketches and the signatures of two rows allow the similarity; the first two never rule out a pair that has it."""
    na, nb = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    sizes = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    bits = F.lit(0)
    for i in range(SKETCH_WORDS):
        bits = bits + F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}")))
    # Similar sets differ in at most (100 - p) / (100 + p) of their sizes' sum.
    return sizes & ((100 + percent) * bits <= (100 - percent) * (na + nb)) & (signature_distance(a, b, chunks) <= distance(chunks))


def own_word(key: Column, a: str, chunks: int) -> Column:
    """The chunk of the signature under the prefix ``a`` that the index of ``key`` is of."""
    slot = key.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    word = F.lit(0).cast("long")
    for i in range(chunks):
        word = F.when((slot >= i * CHOICES) & (slot < (i + 1) * CHOICES), F.col(f"{a}c{i}")).otherwise(word)
    return word


def first_shared(key: Column, a: str, b: str, chunks: int) -> Column:
    """Whether ``key`` is of the first index in which the two rows meet; each has its ``own_word`` as ``own``."""
    chunk = F.when(F.lit(False), -1)
    for i in range(chunks):
        chunk = chunk.when(differing(a, b, i) <= ERRORS, i)
    other, choice = F.col(f"{a}own").bitwiseXOR(F.col(f"{b}own")), F.when(F.lit(False), -1)
    for j, (_, mask) in enumerate(slots(1)):
        choice = choice.when(other.bitwiseAND(F.lit(mask)) == 0, j)
    return key.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) == chunk * CHOICES + choice


def size_band(percent: int) -> Column:
    """Bands of set sizes: similar sets are in one band or in neighbours."""
    # A little wider than the largest ratio, so that rounding can't put a band between two similar sizes.
    return F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent * (1 + 1e-6))).cast("int")


def bucket_pairs(rest: DataFrame, chunks: int, percent: int) -> DataFrame:
    """(a, b) of the possible pairs across the components of a bucket, each in the first bucket that the two share; hubs have met all others."""
    counts = rest.groupBy(F.col("key").alias("of"), F.col("band").alias("in")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).cast("int").alias("parts"))
    with stored(counts) as sizes:
        at = lambda band: (F.col("key") == F.col("of")) & (F.col(band) == F.col("in"))
        # The left side holds a part of a band, the right one all of the band and of the one above.
        x = rest.join(sizes, at("band")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        y = rest.withColumn("low", F.explode(F.array(F.col("band"), F.col("band") - 1))).join(sizes, at("low"))
        y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = _side(x, chunks, "a", "x", "key", F.col("label").alias("la"), "hub", "band", "part")
        y = _side(y, chunks, "b", "y", F.col("key").alias("k"), F.col("label").alias("lb"), F.col("low").alias("yl"), F.col("band").alias("yb"), F.col("part").alias("yp"))
        # After the renaming: the planner keeps what a column was made of under all names, old and new, of each chunk in it, and their
        # combinations (2 ** 12 for 11 chunks) took the driver's whole heap.
        x, y = x.withColumn("xown", own_word(F.col("key"), "x", chunks)), y.withColumn("yown", own_word(F.col("k"), "y", chunks))
        meet = (F.col("key") == F.col("k")) & (F.col("band") == F.col("yl")) & (F.col("part") == F.col("yp"))
        across = ((F.col("band") < F.col("yb")) | (F.col("a") < F.col("b"))) & (F.col("la") != F.col("lb")) & (F.col("a") != F.col("hub")) & (F.col("b") != F.col("hub"))
        both = x.join(y, meet & across & possible("x", "y", chunks, percent) & first_shared(F.col("key"), "x", "y", chunks))
        return checkpointed(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _side(reps: DataFrame, chunks: int, name: str, prefix: str, *more: Column) -> DataFrame:
    return reps.select(F.col("rep").alias(name), *more, *[F.col(c).alias(prefix + c) for c in ("n_shingles", *words_of(chunks))])


def often(pairs: DataFrame, key: str) -> DataFrame:
    """(often, parts) of the keys of more than PAIRS_AT_ONCE pairs."""
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_AT_ONCE)
    return counts.select(F.col(key).alias("often"), F.ceil(F.col("n") / PAIRS_AT_ONCE).cast("int").alias("parts"))


def salted(pairs: DataFrame, heavy: DataFrame, key: str, other: str, side: DataFrame) -> DataFrame:
    """``pairs`` with the row of ``side`` (one to a ``key``); a key in ``heavy`` meets copies of its row, each with a part of its pairs."""
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(heavy, F.col(key) == F.col("often"), "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int"))
    right = side.join(heavy, F.col(key) == F.col("often"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("often", "parts").join(right.drop("often", "parts"), [key, "salt"]).drop("salt")


def within(pairs: DataFrame, reps: DataFrame, chunks: int, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar enough, checkpointed."""
    with stored(often(pairs, "a")) as heavy:
        both = salted(pairs.join(_side(reps, chunks, "b", "y"), "b"), heavy, "a", "b", _side(reps, chunks, "a", "x"))
        return checkpointed(both.filter(possible("x", "y", chunks, percent)).select("a", "b"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough, checkpointed."""
    id_type = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if text_a != last:
                    last, left = text_a, shingles(text_a, size)
                right = shingles(text_b, size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with stored(pairs) as held, stored(often(held, "a")) as of_a, stored(often(held, "b")) as of_b:
        # Only texts that a pair asks for move on: a few by a broadcast, more by a shuffle.
        asked = held.select(F.col("a").alias("id")).union(held.select(F.col("b").alias("id")))
        texts = docs.join(asked, F.col("doc_id") == F.col("id"), "left_semi")
        side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
        both = salted(salted(held, of_b, "b", "a", side("b")), of_a, "a", "b", side("a"))
        # The rows come ordered by ``a``, the side that repeats.
        return checkpointed(both.select("a", "b", "text_a", "text_b").mapInArrow(run, schema))


# -- components --------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node reachable."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = checkpointed(small.select("e.*").filter("a <> b").distinct())
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links of at least ``percent``) of every row."""
    chunks = chunks_for(percent)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = checkpointed(described(docs, size, chunks, "doc_id", "text"))
    reps = checkpointed(rows.filter("n_shingles > 0").groupBy("class", "n_shingles", *words_of(chunks)).agg(F.min("doc_id").alias("rep")))

    # Buckets of more than one class, and the smallest member of each.
    members = reps.select("rep", F.explode(bucket_keys(chunks)).alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("bucket"), "hub")
    shared = checkpointed(members.join(buckets, F.col("key") == F.col("bucket")).select("key", "rep", "hub"))
    stars = checkpointed(shared.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    links = confirmed(within(stars, reps, chunks, percent), docs, size, percent)
    label = components(links)

    # Buckets that still hold several components: pairs across these.
    labelled = shared.join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", "hub", F.coalesce("label", "rep").alias("label"))
    labelled = checkpointed(labelled)
    still = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(F.col("key").alias("bucket"))
    rest = labelled.join(still, F.col("key") == F.col("bucket")).select("key", F.col("rep").alias("member"), "hub", "label")
    rest = checkpointed(rest.join(reps, F.col("rep") == F.col("member")).withColumn("band", size_band(percent)))
    pairs = bucket_pairs(rest, chunks, percent)
    more = confirmed(pairs, docs, size, percent)
    if not more.isEmpty():
        label = components(links.unionByName(more))

    by_class = reps.join(label, F.col("rep") == F.col("node"), "left").select(F.hex("class").alias("key"), F.coalesce("label", "rep").alias("component_id"))
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    return rows.select("doc_id", "n_shingles", F.hex("class").alias("key")).join(by_class, "key", "left").select("doc_id", "n_shingles", own)


def row_key(df: DataFrame, doc_id: str, text: str) -> Column:
    """A string for each different (id, text), null or not, in the order of the ids, null last."""
    own = F.col(doc_id).cast("string")
    if isinstance(df.schema[doc_id].dataType, T.IntegralType):
        own = F.lpad((F.col(doc_id).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), own), F.lit("1")), F.lit(":"), F.coalesce(F.sha2(text, 256), F.lit("")))


def deduplicate(df: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that are the smallest of their component.

    Where ids are null or repeat, a row is known by its id and text together, so unlike texts of one id have each
    their own fate; of rows alike in both, an arbitrary one.
    """
    unclear = df.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return without(df, near_duplicates(df, size, percent, doc_id, text).filter("doc_id <> component_id"), doc_id)
    own = unused(df, "own_key")
    once = df.withColumn(own, row_key(df, doc_id, text)).dropDuplicates([own])
    gone = near_duplicates(once, size, percent, own, text).filter("doc_id <> component_id")
    return without(once, gone, own).select(*df.columns)
