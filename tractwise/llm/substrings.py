"""Exact substring dedup: every byte inside a string of ``LENGTH`` bytes that also starts earlier goes.

Every such window is assigned to an anchor, the least hashed short string inside it, so equal windows
have equal anchors at equal places. Anchors that occur once need no more work. Runs of windows
around equal anchors with equal surroundings are repeats as a whole; where the surroundings differ, the
windows are sorted as suffixes, compared by hash; around very common strings they are grouped by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm.arrow import text_bytes
from tractwise.llm.ngram_join import fixed_filter, mix, passes
from tractwise.session import release, settle

LENGTH = 100
GRAM = 32  # bytes of an anchor
SPAN = LENGTH - GRAM + 1  # anchors that a window can choose from
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20  # windows of a long text that are looked at at a time
JOINED = 1 << 16  # bytes of short texts that are looked at at a time, so that they stay in the processor's cache
HOT = 1 << 18  # windows around one 64-byte string that one task sorts; those of more are dealt by their own bytes
SORTED = 1 << 17  # windows that are sorted at a time, of whole strings
ALONE = 1 << 14  # the same, of a string of more windows or bytes, whose windows are copied one by one
TOGETHER = 1 << 15  # comparisons of suffixes that are made at a time
LAST = 2 ** 63 - 1  # stands for a missing id, which comes last

ANCHORS = "doc_id long, gram long, around long, start long, n long, repeat boolean"


def doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes (modulo 2 ** 64) of the 32 and of the 64 bytes from every place on."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    h, size, out = table[text], 1, []
    while size < 64:
        if len(h) <= size:
            h = np.zeros(0, np.uint64)
        else:
            h = h[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
        if size >= 32:
            out.append(h)
    return out[0], out[1]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from running minima of blocks on both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, hash of the anchor, hash of the surroundings, first window, number of windows, anchor) of every run.

    Short texts are looked at many at a time, long ones piece by piece.
    """
    pieces = []  # runs at the border of a piece are cut there; that only makes them shorter
    for i, raw in enumerate(texts):
        total = len(raw) - LENGTH + 1
        pieces += [(i, begin, raw[begin:min(begin + CHUNK, total) + LENGTH - 1]) for begin in range(0, total, CHUNK)]
    out, at = [], 0
    while at < len(pieces):
        end, held = at, 0
        while end < len(pieces) and (end == at or held + len(pieces[end][2]) <= JOINED):
            held += len(pieces[end][2])
            end += 1
        owner, begin, raw = zip(*pieces[at:end])
        starts = np.cumsum([0, *map(len, raw[:-1])])
        gram, around, first, n, anchor = _runs_in(np.frombuffer(b"".join(raw), np.uint8), starts)
        piece = np.searchsorted(starts, first, "right") - 1
        moved = (np.array(begin) - starts)[piece]
        out.append((np.array(owner)[piece], gram, around, first + moved, n, anchor + moved))
        at = end
    if not out:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs_in(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of the pieces, of ``LENGTH`` bytes at least, that begin at ``starts``; none has a window over two pieces."""
    short, wide = doubled(text)
    scrambled = mix(short)
    places = np.arange(len(short), dtype=np.uint64)
    least = sliding_least(scrambled >> np.uint64(24) << np.uint64(24) | places, SPAN)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    anchor[(starts[1:, None] - np.arange(1, LENGTH)).ravel()] = -1
    first = np.flatnonzero(np.diff(anchor, prepend=-2))
    last = np.append(first[1:], len(anchor)) - 1
    inside = anchor[first] >= 0
    first, last = first[inside], last[inside]
    own = anchor[first]
    size = last - first + LENGTH
    around = mix(wide[first]) + mix(wide[first + np.minimum(64, size - 64)] + np.uint64(1)) * np.uint64(3)
    around = mix(around + mix(wide[last + LENGTH - 64] + np.uint64(2)) * np.uint64(5))
    around = mix(around + (size * 256 + own - first).astype(np.uint64) * np.uint64(BASE))
    return scrambled[own], around, first, last - first + 1, own


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def anchors(docs: DataFrame) -> DataFrame:
    """All runs; those whose surroundings stand earlier in the same document are marked as repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, gram, around, first, n, _ = runs_of(text_bytes(part.column(1)))
                marks = around ^ (gram * np.uint64(3))
                order = np.argsort(marks, kind="stable")  # equal ones of a text stay beside one another, in its order
                marks, texts = marks[order], own[order]
                repeat = np.zeros(len(own), bool)
                repeat[order[1:]] = (marks[1:] == marks[:-1]) & (texts[1:] == texts[:-1])
                rows.append((part.column(0).to_numpy()[own], gram.view(np.int64), around.view(np.int64), first, n, repeat))
                held += len(gram)
                if held > 1 << 16:
                    yield _runs(rows)
                    rows, held = [], 0
            yield _runs(rows)

    return _ids(docs).mapInArrow(run, ANCHORS)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "gram", "around", "start", "n", "repeat"]
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


CONTEXTS = "side long, doc_id long, start long, shift int, n int, bytes binary"


def contexts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes under some runs of windows, keyed by 64 bytes that all these windows hold.

    Windows that begin 32 bytes or more before their anchor all hold those 32 bytes and the anchor; the
    others hold the anchor and the 32 bytes behind it. ``shift`` is how far before the anchor the run begins.
    """
    bits = fixed_filter(runs.select(F.xxhash64("doc_id").alias("h")), "h")
    grouped = runs.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(2).to_numpy(), bits.value))).select([0, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, raw, wanted = part.column(0).to_numpy(), text_bytes(part.column(1)), part.column(2)
                own, _, _, first, n, anchor = runs_of(raw)
                place = own << 40 | first
                asked = np.repeat(np.arange(len(raw)), wanted.value_lengths().to_numpy()) << 40 | wanted.flatten().to_numpy()
                found = np.searchsorted(place, asked)
                found = np.unique(found[(found < len(place)) & (place[np.minimum(found, len(place) - 1)] == asked)]) if len(place) else found[:0]
                own, a, p = own[found], first[found], anchor[found]
                b = a + n[found]
                middle = np.maximum(a, np.minimum(b, p - GRAM + 1))
                own, p, x, y, key = (np.concatenate(c) for c in ((own, own), (p, p), (a, middle), (middle, b), (p - GRAM, p)))
                full = y > x
                own, p, x, y, key = (c[full] for c in (own, p, x, y, key))
                begins = np.cumsum([0, *map(len, raw)])
                flat = np.frombuffer(b"".join(raw), np.uint8)
                strings = np.lib.stride_tricks.sliding_window_view(flat, 64)[begins[own] + key] if len(own) else np.zeros((0, 64), np.uint8)
                held = [raw[i][c:d] for i, c, d in zip(own.tolist(), x.tolist(), (y + LENGTH - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_rows(strings).view(np.int64)), pa.array(ids[own]), pa.array(x), pa.array((p - x).astype(np.int32)),
                     pa.array((y - x).astype(np.int32)), pa.array(held, pa.binary())],
                    names=["side", "doc_id", "start", "shift", "n", "bytes"])

    near = _ids(docs).withColumn("h", F.xxhash64("doc_id")).mapInArrow(prune, "doc_id long, text string")
    return near.join(grouped, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, CONTEXTS)


def hash_rows(strings: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64 bytes."""
    out = np.zeros(len(strings), np.uint64)
    for word in np.ascontiguousarray(strings).view("<u8").T:
        out = (out ^ word) * np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return out


class HashedText:
    """Common extensions of suffixes from prefix hashes, by binary search.

    S[i] sums byte values times powers of the base; two strings of a length are equal if their
    sums, each moved by the power of the other's place, are.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.powers = np.ones(len(text) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(text), BASE, np.uint64), out=self.powers[1:])
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(values[text] * self.powers[:-1], out=self.sums[1:])

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes from i and j, ``most`` at most."""
        out = np.full(len(i), most, np.int64)
        pi, pj, si, sj = self.powers[i], self.powers[j], self.sums[i], self.sums[j]
        rest = np.flatnonzero((self.sums[i + most] - si) * pj != (self.sums[j + most] - sj) * pi)
        i, j, pi, pj, si, sj = (c[rest] for c in (i, j, pi, pj, si, sj))
        low, high = np.zeros(len(i), np.int64), np.full(len(i), most - 1, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (self.sums[i + middle] - si) * pj == (self.sums[j + middle] - sj) * pi
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        out[rest] = low
        return out

    def less(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Whether the suffix from i comes before the one from j; equal ones don't."""
        n = self.common(i, j, most)
        inside = n < most
        at = np.minimum(n, most - 1)
        return inside & (self.text[i + at] < self.text[j + at])


def suffix_sort(text: HashedText, places: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Order of ``places`` (sorted by bucket) that sorts the suffixes within each bucket.

    A stable mergesort of all buckets at once: in every round each element finds its rank in the
    neighbouring run by binary search.
    """
    n = len(places)
    order = np.arange(n)
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(np.append(begins, n))
    begin = np.repeat(begins, sizes)
    size = np.repeat(sizes, sizes)
    width, largest = 1, int(sizes.max()) if n else 0
    while width < largest:
        rank = np.arange(n) - begin
        run = rank // width
        right = run % 2 == 1
        other = begin + np.where(right, (run - 1) * width, np.minimum((run + 1) * width, size))
        end = np.minimum(other + width, begin + size)
        low, high = other.copy(), np.maximum(end, other)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            for at in range(0, len(open_), TOGETHER):
                some = open_[at:at + TOGETHER]
                middle = (low[some] + high[some]) // 2
                a, b, later = places[order[some]], places[order[middle]], right[some]
                # elements of the right run go behind equal ones of the left run
                ahead = later ^ text.less(np.where(later, a, b), np.where(later, b, a), most)
                low[some] = np.where(ahead, middle + 1, low[some])
                high[some] = np.where(ahead, high[some], middle)
        pair = begin + run // 2 * 2 * width
        target = pair + (rank - run * width) + (low - other)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeats_in(side: np.ndarray, doc: np.ndarray, start: np.ndarray, shift: np.ndarray, n: np.ndarray,
               pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows) of the windows that another one equals and precedes.

    Rows come sorted by side. Whole sides are sorted together up to ``SORTED`` windows and 8 * ``SORTED`` bytes;
    larger ones in parts, so that memory does not grow with the windows of a side.
    """
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum([0, *map(len, pieces)])
    owner = np.repeat(np.arange(len(doc)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    places, window, back = begins[owner] + step, start[owner] + step, shift[owner] - step
    ahead = np.lexsort((window, doc[owner], back, side[owner]))
    owner, places, window, back = owner[ahead], places[ahead], window[ahead], back[ahead]
    bucket = np.cumsum((np.diff(side[owner], prepend=0) != 0) | (np.diff(back, prepend=0) != 0))
    same = np.zeros(len(owner), bool)
    rows = np.append(np.flatnonzero(np.diff(side, prepend=~side[:1])), len(side))  # where each side begins
    ends = np.append(0, np.cumsum(n))[rows]  # its windows
    at = 0
    while at < len(rows) - 1:
        most = np.searchsorted(ends, ends[at] + SORTED, "right"), np.searchsorted(begins[rows], begins[rows[at]] + 8 * SORTED, "right")
        end = min(most) - 1
        if end > at:
            x, y, base = ends[at], ends[end], begins[rows[at]]
            same[x:y] = _equal_earlier(flat[base:begins[rows[end]]], places[x:y] - base, bucket[x:y])
        else:
            end = at + 1
            x, y = ends[at], ends[end]
            same[x:y] = _equal_earlier_in_parts(flat, places[x:y], bucket[x:y])
        at = end
    again = np.flatnonzero(same)
    owner, window = owner[again], window[again]
    ahead = np.lexsort((window, owner))
    owner, window = owner[ahead], window[ahead]
    if not len(owner):
        return doc[:0], window, window
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(window, prepend=-9) != 1))
    return doc[owner[first]], window[first], np.diff(np.append(first, len(owner)))


def _equal_earlier(flat: np.ndarray, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each window, sorted by bucket and then from the earliest on, equals an earlier one of its bucket."""
    text = HashedText(flat)
    order = suffix_sort(text, places, bucket, LENGTH)
    places, bucket = places[order], bucket[order]
    windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    same = np.zeros(len(order), bool)
    beside = np.flatnonzero(bucket[1:] == bucket[:-1])
    for at in range(0, len(beside), TOGETHER):  # bounds the bytes that are compared at a time
        b = beside[at:at + TOGETHER]
        b = b[text.common(places[b], places[b + 1], LENGTH) == LENGTH]
        fine = (windows[places[b]] == windows[places[b + 1]]).all(axis=1)
        if not fine.all():
            raise ValueError("hashes of different strings are equal; choose another base")
        same[b + 1] = True
    out = np.zeros(len(order), bool)
    out[order] = same  # the sort is stable, so the earliest of equal ones comes first
    return out


def _equal_earlier_in_parts(flat: np.ndarray, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The same, ``ALONE`` windows at a time in the order of their hashes.

    Equal windows have equal hashes; where a part ends between two of one hash, those of that hash that
    equal no earlier one go before the next part too.
    """
    windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    key = np.zeros(len(places), np.uint64)
    for at in range(0, len(places), ALONE):
        held = windows[places[at:at + ALONE]]
        key[at:at + ALONE] = mix(hash_rows(held[:, :64])) + mix(hash_rows(held[:, LENGTH - 64:]) + np.uint64(1)) * np.uint64(3)
    key = mix(key + bucket.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(key, kind="stable")
    out, kept = np.zeros(len(places), bool), order[:0]
    for at in range(0, len(order), ALONE):
        part = order[at:at + ALONE]
        part = np.sort(np.concatenate([kept[key[kept] == key[part[0]]], part]))
        same = _equal_earlier(windows[places[part]].ravel(), np.arange(len(part)) * LENGTH, bucket[part])
        out[part[same]] = True
        kept = part[~same & (key[part] == key[order[min(at + ALONE, len(order)) - 1]])]
    return out


def sorted_repeats(rows: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """Windows under the contexts that repeat an earlier one."""
    spread = rows.repartition("side").sortWithinPartitions("side")

    def found(table: pa.Table) -> pa.RecordBatch:
        side, doc, start, shift, n = (table.column(i).to_numpy() for i in range(5))
        out = repeats_in(side, doc, start, shift.astype(np.int64), n.astype(np.int64), table.column(5).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                table = pa.Table.from_batches([batch.slice(at, 1024)])
                held = table if held is None else pa.concat_tables([held, table])
                if held.column(5).nbytes < batch_bytes or held.column(0)[0] == held.column(0)[-1]:
                    continue
                side = held.column(0).to_numpy()
                end = int(np.flatnonzero(side[1:] != side[:-1])[-1]) + 1
                yield found(held.slice(0, end))
                held = held.slice(end).combine_chunks()
        if held is not None:
            yield found(held)

    return spread.mapInArrow(run, "doc_id long, start long, n long")


def windows_of(rows: DataFrame, wanted=None) -> DataFrame:
    """key, doc_id and start of every window under the contexts; its bytes too, of those whose key may be ``wanted``.

    The key is a hash of the window, its place and its 64-byte string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                side, doc, start, shift, n = (part.column(i).to_numpy().astype(np.int64) for i in range(5))
                pieces = part.column(5).to_pylist()
                flat = np.frombuffer(b"".join(pieces), np.uint8)
                begins = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(np.int64)
                owner = np.repeat(np.arange(len(doc)), n)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                places = begins[owner] + step
                wide = doubled(flat)[1]
                key = mix(wide[places]) + mix(wide[places + LENGTH - 64] + np.uint64(1)) * np.uint64(3)
                key = mix(key + mix(side[owner].view(np.uint64) + np.uint64(2)) * np.uint64(5))
                key = mix(key + (shift[owner] - step).astype(np.uint64) * np.uint64(BASE)).view(np.int64)
                columns = [key, doc[owner], start[owner] + step]
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc_id", "start"])
                    continue
                own = np.flatnonzero(passes(key, wanted.value))
                data = np.ascontiguousarray(flat[places[own][:, None] + np.arange(LENGTH)])
                ends = np.arange(len(own) + 1, dtype=np.int32) * np.int32(LENGTH)
                held = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[own]) for c in columns), held], names=["key", "doc_id", "start", "bytes"])

    return rows.mapInArrow(run, "key long, doc_id long, start long" + (", bytes binary" if wanted else ""))


def dealt_repeats(rows: DataFrame) -> DataFrame:
    """The same as ``sorted_repeats``, window by window, for strings that have any number of windows.

    The earliest window of each key is found by a partial aggregate; all others are compared with
    its bytes, in a join that Spark can split.
    """
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("start")
    place = place.cast("decimal(38,0)").alias("place")
    least = windows_of(rows).select("key", place).groupBy("key").agg(F.min("place").alias("least"), F.count("*").alias("c"))
    least = settle(least.filter("c > 1").select("key", "least"))
    same = windows_of(rows, fixed_filter(least, "key")).select("*", place).join(least, "key")
    same = settle(same.select("key", "doc_id", "start", "bytes", (F.col("place") > F.col("least")).alias("later")))
    first = settle(same.filter("NOT later").groupBy("key").agg(F.first("bytes").alias("first")))
    fine = F.when(F.col("bytes") == F.col("first"), F.lit(True)).otherwise(
        F.raise_error(F.lit("hashes of different strings are equal; choose another base")).cast("boolean"))
    out = settle(same.filter("later").join(first, "key").filter(fine).select("doc_id", "start", F.lit(1).cast("long").alias("n")))
    release(least, same, first)
    return out


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, start and n: runs of n windows from start on that also start earlier, as ``repeated_by_document`` finds them."""
    return repeated_by_document(docs, hot).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.start", "run.n")


def repeated_by_document(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id and runs, a sorted array of (start, n): runs of n windows from start on that also start earlier.

    Documents come in the order of their ids; one without an id comes last; rows that repeat an id
    don't count as earlier than one another.
    """
    table = settle(anchors(docs))
    shared = table.filter("NOT repeat").groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    bits = fixed_filter(shared, "gram")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(1).to_numpy(), bits.value)))

    names = "doc_id long, gram long, around long, start long, n long"
    rows = settle(table.filter("NOT repeat").drop("repeat").mapInArrow(prune, names))
    classes = settle(rows.groupBy("gram", "around").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")))
    mixed = classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    copies = rows.join(classes.filter("c > 1"), ["gram", "around"]).filter("doc_id > first")
    heads = rows.join(classes, ["gram", "around"]).filter("doc_id = first").join(mixed, "gram", "left_semi")
    sides = settle(contexts(docs, settle(heads.select("doc_id", "start").distinct())))
    alike = settle(sides.groupBy("side").agg(F.count("*").alias("c"), F.sum("n").alias("windows")).filter("c > 1"))
    fields = [c.split()[0] for c in CONTEXTS.split(", ")]
    many, rest = alike.filter(F.col("windows") > hot).select("side"), sides
    if not many.isEmpty():
        # there is at most one such string for every ``hot`` windows
        rest = sides.join(F.broadcast(many), "side", "left_anti")
        dealt = dealt_repeats(sides.join(F.broadcast(many), "side", "left_semi").select(*fields))
    else:
        dealt = None
    partial = sorted_repeats(rest.join(alike.select("side"), "side", "left_semi").select(*fields))
    partial = partial if dealt is None else partial.unionByName(dealt)
    whole = table.filter("repeat").select("doc_id", "start", "n").unionByName(copies.select("doc_id", "start", "n"))
    runs = whole.unionByName(partial).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    out = settle(runs)
    release(table, rows, classes, sides, alike, *([] if dealt is None else [dealt]))
    return out


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def dedup_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay, of every document.

    Null and empty texts have no bytes; texts of fewer than ``LENGTH`` bytes stay whole; other columns
    are ignored. What stays need not be valid UTF-8.
    """
    grouped = repeated_by_document(docs, hot)
    bits = fixed_filter(grouped.select(F.xxhash64("doc_id").alias("h")), "h")

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(2).to_numpy(), bits.value))).select([0, 1])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # cut at once, as a second pass in the same stage would need Python workers of its own
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pa.array(~passes(part.column(2).to_numpy(), bits.value)))
                yield from cut([pa.RecordBatch.from_arrays([*part.columns[:2], pa.nulls(part.num_rows, RUNS)], names=["doc_id", "text", "runs"])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                cuts, begin, end = _merged(part.column(2))
                for i, (doc, raw) in enumerate(zip(part.column(0).to_pylist(), text_bytes(part.column(1)))):
                    out, last, gone = [], 0, 0
                    for a, b in zip(begin[cuts[i]:cuts[i + 1]], end[cuts[i]:cuts[i + 1]]):
                        out.append(raw[last:a])
                        gone, last = gone + b - a, b
                    out.append(raw[last:])
                    rows.append((None if doc == LAST else doc, len(raw), gone, cuts[i + 1] - cuts[i], b"".join(out)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(
                    zip(*rows), (*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = _ids(docs).withColumn("h", F.xxhash64("doc_id"))
    changed = marked.mapInArrow(touched, "doc_id long, text string").join(grouped, "doc_id", "left").select("doc_id", "text", "runs")
    return changed.mapInArrow(cut, CUT).unionByName(marked.mapInArrow(rest, CUT))


def _merged(runs: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """Runs of removed bytes of all texts: the first of each text (and their number), where they begin, where they end."""
    own = np.repeat(np.arange(len(runs)), runs.value_lengths().fill_null(0).to_numpy())
    flat = runs.flatten()
    start, n = (flat.field(k).to_numpy() for k in ("start", "n"))
    reach = np.maximum.accumulate((own << 40) + start + n + LENGTH - 1)  # the texts before one reach less far than it begins
    first = np.flatnonzero((own << 40) + start > np.append(-1, reach[:-1])) if len(own) else own
    last = np.append(first[1:], len(own))[:len(first)] - 1
    cuts = np.searchsorted(own[first], np.arange(len(runs) + 1))
    return cuts.tolist(), start[first].tolist(), (reach[last] - (own[last] << 40)).tolist()


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a hash of the rest."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
