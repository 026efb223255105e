"""Token-ID / binary output: length-delimited records with masked checksums and an offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.functions.ranks import running_sums
from tractwise.llm.tokens import default_vocabulary, wide, worker_encoder
from tractwise.session import scratch_path

# Fixed values of the file format. All integers are little-endian.
#   file    = MAGIC, id width (uint16), record...
#   record  = payload length (uint64), masked crc32 of those 8 bytes (uint32), payload,
#             masked crc32 of the payload (uint32)
#   payload = flags (uint8; 1: the document has no id), document id (int64), token ids
#   masked(c) = rotate right by 15 bits, plus MASK, modulo 2 ** 32
MAGIC = b"TWREC1"
MASK = 0xA282EAD8
HEAD, TAIL, OWN = "<QI", "<I", "<Bq"
HEAD_BYTES, TAIL_BYTES, OWN_BYTES = 12, 4, 9

INDEX = "doc_id long, shard long, part long, file string, offset long, length long, n_tokens long"
FILES_PER_BUCKET = 1000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack(TAIL, masked(head)) + payload + struct.pack(TAIL, masked(payload))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end of the file; ValueError if a checksum doesn't fit."""
    head = stream.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES:
        raise ValueError("a record breaks off")
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    body = stream.read(length + TAIL_BYTES)
    if len(body) < length + TAIL_BYTES or struct.unpack(TAIL, body[length:])[0] != masked(body[:length]):
        raise ValueError("a record is damaged")
    return body[:length]


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = 2,
                  file_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of every text, in ascending doc_id order, and return the offset index.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null text counts as empty;
    a null doc_id comes first; repeated ids are all written, ordered by their texts. An empty table
    writes an empty index. Shards follow ranges of doc_id, a file ends after ``file_bytes``. A task
    that runs again writes files of a new name, and only files named by the index count, so lost
    executors and speculative tasks do no harm. ``path`` must be a folder all executors share.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        encoder = worker_encoder(vocabulary)
        end = b"" if end_id is None else encoder.pack(end_id)
        shard, part, out, at = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    part += 1
                    name = f"shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.rec"
                    out = files.open_output_stream(f"{folder}/{name}")
                    at = out.write(MAGIC + struct.pack("<H", encoder.width))
                ids = encoder.encode(text.as_py()) + end
                record = frame(struct.pack(OWN, doc is None, doc or 0) + ids)
                out.write(record)
                rows.append((doc, shard, part, name, at, len(record), len(ids) // encoder.width))
                at += len(record)
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc_id", "shard", "part", "file", "offset", "length", "n_tokens"])
        if out is not None:
            out.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(write, INDEX)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def shards(index: DataFrame) -> DataFrame:
    """One row per file, with the number of ids in all files before it."""
    files = index.groupBy("shard", "part", "file").agg(F.sum("n_tokens").alias("n_tokens"))
    files = files.withColumn("place", F.struct("shard", "part"))
    files = files.withColumn("bucket", F.floor(F.col("shard") / FILES_PER_BUCKET))
    return running_sums(files, [], "place", "bucket", ["n_tokens"]).select(
        "shard", "part", "file", (F.col("cum_n_tokens") - F.col("n_tokens")).alias("before"))


RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_records(index: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Every record of the files named by the index, read from first to last and verified.

    Returns doc_id, start (ids in all records before it), n_tokens, ids_crc32 (over 32-bit ids)
    and, if asked for, the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{folder}/{name}", buffer_size=1 << 20) as stream:
                    if stream.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no record file")
                    width = struct.unpack("<H", stream.read(2))[0]
                    rows, held = [], 0
                    while (payload := read_frame(stream)) is not None:
                        none, doc = struct.unpack_from(OWN, payload)
                        ids = wide(payload[OWN_BYTES:], width)
                        raw = ids.tobytes()
                        rows.append((None if none else doc, before, len(ids), zlib.crc32(raw),
                                     raw if with_ids else None))
                        before += len(ids)
                        held += len(raw) if with_ids else 64
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    found = shards(index).select("shard", "part", "file", "before")
    n = max(1, index.select("file").distinct().count())
    spread = found.repartitionByRange(n, "shard", "part").select("file", "before")
    out = spread.mapInArrow(read, RECORDS)
    return out if with_ids else out.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def fetch(index: DataFrame, path: str) -> DataFrame:
    """The records of some index rows, in the rows' own order inside each partition, by their offsets.

    For shuffled reads: ``fetch(index.orderBy(F.rand(seed)), path)``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with files.open_input_file(f"{folder}/{row['file']}") as stream:
                    stream.seek(len(MAGIC))
                    width = struct.unpack("<H", stream.read(2))[0]
                    stream.seek(row["offset"])
                    payload = read_frame(stream)
                none, doc = struct.unpack_from(OWN, payload)
                ids = wide(payload[OWN_BYTES:], width)
                raw = ids.tobytes()
                rows.append((None if none else doc, None, len(ids), zlib.crc32(raw), raw))
            yield _batch(rows)

    return index.select("file", "offset").mapInArrow(read, RECORDS).drop("start")


def op1_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents, written to a new folder and read back from its files."""
    path = scratch_path(spark, "records")
    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_records(index, path, with_ids=False)
