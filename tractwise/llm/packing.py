"""Packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractwise.llm.tokens import default_vocabulary, wide, worker_encoder
from tractwise.session import settle

MAX_TOKENS = 1024

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, "
          "place long, width int, ids binary")


def cut(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None,
        end_id: int | None = 0) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: whole blocks, then the rest of the document.

    A piece knows its ``task`` and its ``place`` among that task's pieces of the same length, so
    that ranks over all pieces need no sort of the pieces. The frame has to be written before it is
    used twice.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        end = b"" if end_id is None else encoder.pack(end_id)
        task, step = TaskContext.get().partitionId(), max_tokens * encoder.width
        seen = np.zeros(max_tokens + 1, dtype=np.int64)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // encoder.width
                for at in range(0, len(ids), step):
                    own = ids[at:at + step]
                    n = len(own) // encoder.width
                    rows.append((doc, at // encoder.width, n, zlib.crc32(wide(own, encoder.width).tobytes()),
                                 total, task, int(seen[n]), encoder.width, own))
                    seen[n] += 1
                held += len(ids)
                if held > 8 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
        yield _pieces(rows)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in their order) and how often each is used.

    Lengths go in longest first, each into the open pattern with the most room left, as many at a
    time as there are both of the length and of the pattern. The work follows the number of
    distinct lengths, not the number of pieces.
    """
    open_: list[tuple[int, int, tuple[int, ...], int]] = []  # (-room, age, lengths, count)
    done: list[tuple[tuple[int, ...], int]] = []
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        later = []
        while left > 0:
            if open_ and -open_[0][0] >= length:
                room, born, lengths, count = heapq.heappop(open_)
                used = min(left, count)
                if count > used:
                    heapq.heappush(open_, (room, born, lengths, count - used))
                lengths, room = (*lengths, length), -room - length
            else:
                used, lengths, room = left, (length,), max_tokens - length
            left -= used
            age += 1
            if room:
                later.append((-room, age, lengths, used))
            else:
                done.append((lengths, used))
            # what a pattern has gained is open to further pieces of the same length
            for x in later:
                heapq.heappush(open_, x)
            later = []
    return done + [(lengths, count) for _, _, lengths, count in open_]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): which ranks of a length go where."""
    rows, ranks, sequence = [], {}, 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            rows.append((length, first, count, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return rows


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece of a written ``cut`` table.

    Only the histogram, at most ``max_tokens`` rows, meets on the driver. A piece's rank among its
    length is its place in its task plus the pieces of that length in earlier tasks; the rank picks
    the slot of a pattern. Hot lengths are spread over the tasks that cut them. Repeated documents
    and ids are packed as often as they occur; an empty table gives an empty one.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = sorted(slots(shortest_pack_first(histogram, max_tokens)))
    by_length = {n: np.array([r[1:] for r in table if r[0] == n], dtype=np.int64).T for n in {r[0] for r in table}}

    columns = [c for c in pieces.columns if c not in ("task", "place", "sequence_id", "offset")]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, _, where, at = by_length[int(n)]
                slot = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = where[slot] + rank[own] - first[slot], at[slot]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             names=[*columns, "sequence_id", "offset"])

    ranked = pieces.join(before.drop("n"), ["length", "task"]).withColumn(
        "rank", F.col("before") + F.col("place")).drop("before", "task", "place")
    return ranked.mapInArrow(put, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: ids (little-endian, 32 bits each) and the documents of their pieces, by offset."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out = []
            for row in batch.column(names.index("parts")).to_pylist():
                out.append(b"".join(wide(p["ids"], p["width"]).tobytes() for p in row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("sequence_id")), pa.array(out, pa.binary()),
                 batch.column(names.index("doc_ids"))], names=["sequence_id", "ids", "doc_ids"])

    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "doc_id", "width", "ids"))).alias("parts"))
    return parts.withColumn("doc_ids", F.col("parts.doc_id")).mapInArrow(
        join, "sequence_id long, ids binary, doc_ids array<long>")


def placements(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Where each piece of each document goes, without the ids themselves."""
    pieces = settle(cut(docs, max_tokens, vocabulary))
    return pack(pieces.drop("ids", "width"), max_tokens).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of all documents' pieces in sequences of at most 1024 ids."""
    return placements(spark.read.parquet(f"{sf_dir}/documents.parquet"))
