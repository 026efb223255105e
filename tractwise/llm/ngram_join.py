"""N-gram Jaccard join: parity sketches, joined segment by segment within bands of set sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm.arrow import text_bytes
from tractwise.llm.components import components
from tractwise.session import release, settle

WORDS = 4
SIMILAR = (85, 100)
BAND = 1.384  # the ratio of sizes within a band; over the square root of any step between partners
SKETCH_BITS = 1024  # of the shortest parity sketch; others have at least 3 for each shingle
CODE_BITS = 512  # of the shortest code that a bucket's members are held against one another by; others have one for each shingle at least
GROUP = 1024  # members of a bucket that are held against one another at a time
FILTER_BITS = 1 << 25  # of the fixed-size filters that only save shuffling
CHUNK = 4 << 20
KEY_BYTES = 6  # of a segment key; keys that are equal by chance only cost a comparison
PART_KEYS = 1 << 23  # keys looked through at a time for those that occur twice
PRIME = 0x9E3779B97F4A7C15

SKETCHES = "doc_id long, n_shingles long, f long, g long, n_keys long, keys binary, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of lower-cased bytes, white space being 0."""
    inside = text != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    # A scrambled factor for each place: with powers of one number some long words would be told apart by nothing.
    factors = mix(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(PRIME))
    letters = text[inside].astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(letters)) - np.repeat(begins, sizes)
    sums = np.add.reduceat(letters * factors[place], begins)
    return starts, mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; all words as one, if there are fewer."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0] = 1  # a NUL byte is part of a word; byte 1 would be no different to the hash, so it moves on
    table[1] = 255
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        flat = table[np.frombuffer(b" ".join(texts[at:end]), np.uint8)]
        doc_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:end]])])
        places, hashes, begin = [], [], 0
        while begin < len(flat):  # long texts in pieces that end at white space
            stop = begin + CHUNK
            while stop < len(flat):
                gap = np.flatnonzero(flat[stop:stop + CHUNK] == 0)
                if len(gap):
                    stop += int(gap[0])
                    break
                stop += CHUNK
            p, h = _word_hashes(flat[begin:stop])
            places.append(p + begin)
            hashes.append(h)
            begin = stop
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        bounds = np.searchsorted(np.concatenate(places) if places else np.zeros(0, np.int64), doc_starts)
        grams = words
        if len(words) >= size:
            grams = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                grams = grams * np.uint64(PRIME) + words[k:len(words) - size + 1 + k]
            grams = mix(grams + np.uint64(size))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                own = np.sort(grams[a:b - size + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                whole = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        whole = whole * np.uint64(PRIME) + w
                out.append(mix(np.array([whole], np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = end
    return out


class Bands:
    """Bands of set sizes, and how many segments the sketches of a band are cut into.

    Sets of a and b shingles that are similar enough differ in at most share * (a + b) shingles, and
    their sizes lie in one band or in neighbouring ones.
    """

    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.num, self.den = similar
        self.edges: list[tuple[int, int, int]] = []
        self._grow(1)

    def differ(self, total: int) -> int:
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, size: int) -> int:
        return size * self.den // self.num

    def _grow(self, size: int) -> None:
        while not self.edges or self.edges[-1][1] < size:
            low = self.edges[-1][1] + 1 if self.edges else 1
            high = max(low, int(low * BAND), self.largest(low))
            most = self.differ(high + self.largest(high))
            self.edges.append((low, high, most + 1 + round(0.05 * most)))

    def levels(self, size: int) -> list[tuple[int, int, int]]:
        """(level, segments, differences at most) under which a set of that size is looked for."""
        self._grow(size)
        lo, hi = 0, len(self.edges) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.edges[mid][1] >= size else (mid + 1, hi)
        out = [(lo, self.edges[lo][2], self.differ(size + self.largest(size)))]
        if lo and self.largest(self.edges[lo - 1][1]) >= size:
            out.append((lo - 1, self.edges[lo - 1][2], self.differ(size + self.edges[lo - 1][1])))
        return out


def segment_keys(grams: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the segments of a sorted set, one of which any similar set must share.

    Every shingle falls into one of the level's segments; a key is the exclusive or of all shingles in
    its segment. Two sets with at most d differences agree in all segments but d. Segments
    with fewer than two shingles say little: a set passes them over and goes on to further
    segments, until d + 1 others are taken. Sets with too many of them use all segments.
    """
    if not len(grams):
        return np.zeros(0, np.uint64)
    running = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(grams)])
    high = grams >> np.uint64(32)
    keys = []
    for level, segments, most in bands.levels(len(grams)):
        cuts = np.searchsorted((high * np.uint64(segments)) >> np.uint64(32), np.arange(segments + 1))
        strong = np.flatnonzero(np.diff(cuts) >= 2)
        if len(strong) > most:
            take = strong[:most + 1]
        else:
            take = np.arange(segments)
        own = running[cuts[take + 1]] ^ running[cuts[take]]
        tag = mix(np.full(len(take), level * 0x10001 + 7, np.uint64) * np.uint64(PRIME) + take.astype(np.uint64))
        keys.append(mix(own ^ tag))
    return np.concatenate(keys) & np.uint64((1 << 8 * KEY_BYTES) - 1)


def pack(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each 64-bit value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel()


def parity_sketch(grams: np.ndarray) -> bytes:
    """Every shingle flips one bit, so two sketches differ in no more bits than the sets in shingles.

    Larger sets have longer sketches; a longer one, its parts laid over one another, is the shorter one.
    """
    bits = SKETCH_BITS
    while bits < 3 * len(grams):
        bits *= 2
    flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """128 bits of a sorted set, as two values: sets with equal ones are taken for equal."""
    return np.frombuffer(blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)


def sketches(docs: DataFrame, words: int, keys_of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """Set size, fingerprint of the set, bucket keys and parity sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(text_bytes(part.column(1)), words)
                keys = keys_of(sets)
                prints = np.stack([fingerprint(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                     pa.array([len(k) for k in keys], pa.int64()),
                     pa.array([pack(k, KEY_BYTES) for k in keys], pa.binary()),
                     pa.array([parity_sketch(s) for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "f", "g", "n_keys", "keys", "sketch"])

    return _plain(docs).mapInArrow(run, SKETCHES)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fixed_filter(values: DataFrame, name: str):
    """A bit map of fixed size, broadcast, that has the bit of every value set; others may pass it too."""
    place = F.pmod(F.col(name), F.lit(FILTER_BITS))
    rows = values.select(F.shiftright(place, 6).alias("word"), (F.pmod(place, F.lit(64))).cast("int").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    found = rows.toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return values.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def passes(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    place = (values % np.int64(FILTER_BITS)).astype(np.uint64)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shared_keys(table: DataFrame, ids) -> DataFrame:
    """Every ``key`` that occurs more than once in the rows whose ids the bit map ``ids`` lets pass.

    Keys travel as bytes, sorted into as many ranges as their number asks for. A task sends a key
    twice at most however often it has it, so a key of very many documents is no burden on its range.
    """
    total = table.agg(F.sum("n_keys")).first()[0] or 0
    parts = max(32, -(-total // PART_KEYS))

    def ranges(raw: list[bytes]) -> pa.RecordBatch:
        keys = np.sort(unpack(b"".join(raw), KEY_BYTES))
        keys = keys[np.concatenate([np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]])]
        part = ((keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        used, at = np.unique(part, return_index=True)
        cuts = [*at.tolist(), len(keys)]
        pieces = [pack(keys[x:y], KEY_BYTES) for x, y in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(pieces, pa.binary())], names=["part", "keys"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0).filter(pa.array(passes(batch.column(1).to_numpy(), ids.value))).to_pylist():
                held.append(raw)
                size += len(raw)
                if size >= KEY_BYTES * CHUNK:
                    yield ranges(held)
                    held, size = [], 0
        if held:
            yield ranges(held)

    def repeated(group: pa.Table) -> pa.Table:
        keys = np.sort(unpack(b"".join(group.column("keys").to_pylist()), KEY_BYTES))
        return pa.table({"key": signed(np.unique(keys[1:][keys[1:] == keys[:-1]]))})

    pieces = table.select("keys", F.xxhash64("doc_id").alias("h")).mapInArrow(cut, "part long, keys binary")
    return pieces.groupBy("part").applyInArrow(repeated, "key long")


def members(table: DataFrame, shared: DataFrame, ids) -> DataFrame:
    """(key, doc_id) of all keys that the fixed-size filter of the shared keys lets pass, in the rows that ``ids`` lets pass."""
    bits = fixed_filter(shared, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                part = part.filter(pa.array(passes(part.column(2).to_numpy(), ids.value)))
                raw = part.column(1).to_pylist()
                keys = unpack(b"".join(raw), KEY_BYTES).view(np.int64)
                docs = np.repeat(part.column(0).to_numpy(), [len(r) // KEY_BYTES for r in raw])
                keep = passes(keys, bits.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(docs[keep])], names=["key", "doc_id"])

    return table.select("doc_id", "keys", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "key long, doc_id long")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Shingle sets, the sorted hashes as bytes, of the documents with those ids (and a few more)."""
    bits = fixed_filter(ids.select(F.xxhash64("doc_id").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passes(batch.column(2).to_numpy(), bits.value))
            part = batch.filter(keep)
            sets = []
            for at in range(0, part.num_rows, 1024):
                sets += [s.tobytes() for s in shingle_sets(text_bytes(part.column(1).slice(at, 1024)), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    plain = _plain(docs).filter("doc_id IS NOT NULL")
    return plain.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, set binary")


def verify(docs: DataFrame, pairs: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, by the sets themselves."""
    num, den = similar
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = settle(sets_of(docs, ids, words))
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    out = settle(joined.mapInArrow(run, "a long, b long").distinct())
    release(sets)
    return out


def _close(pairs: DataFrame, table: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Drop the pairs whose sizes or sketches are too far apart."""
    num, den = similar
    left = table.select(F.col("doc_id").alias("a"), F.struct("n_shingles", "sketch").alias("x"))
    right = table.select(F.col("doc_id").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    total = F.col("x.n_shingles") + F.col("y.n_shingles")
    sized = den * F.least("x.n_shingles", "y.n_shingles") >= num * F.greatest("x.n_shingles", "y.n_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                size = min(len(x), len(y))
                far = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))
                keep.append(far * (den + num) <= (den - num) * n)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.filter(sized).select("a", "b", "x.sketch", F.col("y.sketch").alias("other"), total.alias("n")).mapInArrow(run, "a long, b long")


def short_codes(table: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the sketch, folded to a bit or two for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                size = CODE_BITS // 8
                while 8 * size < n:
                    size *= 2
                codes.append(folded(raw, size).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())],
                                             names=["doc_id", "n_shingles", "sketch"])

    return table.select("doc_id", "n_shingles", "sketch").mapInArrow(run, "doc_id long, n_shingles long, sketch binary")


def joined_buckets(rows: DataFrame) -> DataFrame:
    """key and doc_id of the rows of key, doc_id and first, without the first ones; the buckets of one first document are one.

    Near copies share most of their keys, and so the first document of their buckets: as one bucket
    they are rows of it once, not once for each key. Documents that shared a key still share one.
    Buckets stay apart where that takes fewer rows, as a bucket of many blocks is copied for each of them.
    """
    rest = rows.filter("doc_id <> first")
    cost = F.sum(F.col("c") * F.ceil(F.col("c") / GROUP))
    once = rest.select("first", "doc_id").distinct()
    together = once.groupBy("first").agg(F.count("*").alias("c")).select("first", (F.col("c") * F.ceil(F.col("c") / GROUP)).alias("one"))
    apart = rest.groupBy("first", "key").agg(F.count("*").alias("c")).groupBy("first").agg(cost.alias("all"))
    kinds = settle(together.join(apart, "first").select("first", (F.col("one") <= F.col("all")).alias("join")))
    one = once.join(kinds.filter("join"), "first", "left_semi").select(F.xxhash64("first").alias("key"), "doc_id")
    out = settle(one.unionByName(rest.join(kinds.filter("NOT join"), "first", "left_semi").select("key", "doc_id")))
    release(kinds)
    return out


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """Those rows of key, doc_id and component whose key has several components; of keys with the same members, one.

    Near copies share most of their keys, so their buckets are often the same ones over and over.
    """
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"m{i}") for i in range(2)]
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *marks)
    one = keys.filter("low < high").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    return placed.join(one, "key", "left_semi").select("key", "doc_id", "component")


def spread_blocks(rows: DataFrame) -> DataFrame:
    """Deal every bucket's rows to groups (key, p, q) in which all that may meet do meet.

    ``rows`` has key, doc_id, component, n_shingles and sketch. The rows of a bucket's largest
    component have nothing to look for among one another; they are cut into blocks, the other rows into
    blocks of their own, and each of these meets every block. So a large component with a few others
    beside it costs a few copies of its rows.
    """
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    tops = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("n"))
    tops = tops.filter("most < n").select("key", "top", F.ceil(F.col("most") / GROUP).cast("long").alias("large"),
                                          F.ceil((F.col("n") - F.col("most")) / GROUP).cast("long").alias("small"))
    inside = F.col("component") == F.col("top")
    hashed = F.xxhash64("doc_id", F.lit(3))
    own = F.when(inside, F.col("small") + F.pmod(hashed, F.col("large"))).otherwise(F.pmod(hashed, F.col("small")))
    others = F.sequence(F.lit(0).cast("long"), F.col("small") + F.when(inside, F.lit(0)).otherwise(F.col("large")) - 1)
    dealt = rows.join(tops, "key").withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own",
                         "doc_id", "component", "n_shingles", "sketch")
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def bucket_pairs(rows: DataFrame, similar: tuple[int, int], limit: int) -> DataFrame:
    """key, a, b and cut: pairs of a bucket's rows of different components whose sizes and sketches allow a link.

    Within a group a row looks for partners in components that have more rows there than its own, and
    takes the ``limit`` nearest by sketch; ``cut`` says that it left others. No row is made for pairs
    that the sketches rule out.
    """
    num, den = similar

    def pairs_of(group: pa.Table) -> list[tuple[int, int, int, bool]]:
        key, p, q, own, doc, comp, n = (group.column(i).to_numpy() for i in range(7))
        names, at, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return []
        raw = group.column(7).to_pylist()
        least = min(map(len, raw))
        sketch = np.stack([folded(r, least) for r in raw])
        weight = np.argsort(np.lexsort((names, sizes)))[at]
        out = []
        for i in range(len(doc)):
            ok = (weight > weight[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & ((own != own[i]) | (p[0] == q[0]))
            found = np.flatnonzero(ok)
            if not len(found):
                continue
            far = np.bitwise_count(sketch[found] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = far * (den + num) <= (den - num) * (n[found] + n[i])
            found, far = found[near], far[near]
            for j in found[np.argsort(far, kind="stable")[:limit]].tolist():
                out.append((int(key[0]), min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j])), len(found) > limit))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            key, p, q = (table.column(i).to_numpy() for i in range(3))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            yield _pairs(table, np.concatenate([[0], ends]).tolist(), pairs_of)
            held = table.slice(int(ends[-1]) if len(ends) else 0).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield _pairs(table, [0, table.num_rows], pairs_of)

    return spread_blocks(rows).mapInArrow(run, "key long, a long, b long, cut boolean")


def _pairs(table: pa.Table, cuts: list[int], pairs_of) -> pa.RecordBatch:
    """Pairs of all groups between the cuts."""
    found = [x for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1 for x in pairs_of(table.slice(a, b - a))]
    columns = zip(*found) if found else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "a", "b", "cut"])


def link(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, by the segments of parity sketches.

    See ``linked`` for what it does with odd rows.
    """

    def keys_of(sets: list[np.ndarray]) -> list[np.ndarray]:
        bands = Bands(similar)
        return [segment_keys(s, bands) for s in sets]

    return linked(docs, keys_of, words, similar)


def linked(docs: DataFrame, keys_of: Callable[[list[np.ndarray]], list[np.ndarray]], words: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; documents that share a bucket key are compared.

    Null and empty texts have no shingles and link with nothing; rows without an id are returned
    without a component; rows that repeat an id are one document, which all its texts' links reach.
    Documents with equal sets are one, the smallest id, before anything is joined. Every bucket first
    links its members to its smallest id. Members that this leaves in different components are
    compared with one another, nearest first, in rounds that let each take more partners than the
    last, until none has left any: no link between components is lost, and few within them are looked for.
    """
    table = settle(sketches(docs, words, keys_of))
    known = table.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = settle(known.groupBy("n_shingles", "f", "g").agg(F.min("doc_id").alias("doc_id")))
    ids = fixed_filter(sets.select(F.xxhash64("doc_id").alias("h")), "h")  # a copy that passes too only meets its first again
    copies = known.select("doc_id", "n_shingles", "f", "g").join(sets.withColumnRenamed("doc_id", "a"), ["n_shingles", "f", "g"]).filter(
        "doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()

    shared = settle(shared_keys(known, ids))
    held = settle(members(known, shared, ids))
    buckets = held.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    rows = settle(held.join(buckets.filter("first < last").drop("last"), "key"))
    release(shared, held)
    stars = rows.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = settle(_close(stars, known, similar))
    verified = verify(docs, near, words, similar)
    parts = settle(components(copies.unionByName(verified)))
    release(sets, near, verified)

    codes, tried, limit = settle(short_codes(known)), None, 4
    open_ = joined_buckets(rows)  # each key's first has met all others already
    while True:
        placed = open_.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        found = settle(bucket_pairs(mixed_buckets(placed).join(codes, "doc_id"), similar, limit))
        pairs = found.select("a", "b").distinct()
        pairs = settle(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if found.limit(1).count():
            near = settle(_close(pairs, known, similar))
            more = verify(docs, near, words, similar)
            star = parts.select(F.col("component").alias("a"), F.col("node").alias("b"))
            wider = settle(components(star.unionByName(more)))
            release(parts, near, more)
            parts = wider
        more_keys = found.filter("cut").select("key").distinct()
        if not more_keys.limit(1).count():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        wider = settle(open_.join(more_keys, "key", "left_semi"))
        release(open_, found)
        open_ = wider
        limit *= 8
    sizes = settle(table.select("doc_id", "n_shingles"))
    release(table, rows, codes, open_, found, pairs)
    return sizes.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents, in their own columns, that are the first of their group of similar ones."""
    name = f"id_{uuid.uuid4().hex}"
    first = link(docs, words, similar).filter("component_id = doc_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    return kept.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (
  WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT * FROM t)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(grams)
"""
