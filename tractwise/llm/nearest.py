"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractwise.session import settle

K = 5
SPREAD = 4  # bits of a code per dimension
EPSILON = 3.0  # standard errors on either side of an estimated cosine
SEED = 20240517
QUERIES_AT_ONCE = 4096  # broadcast at a time: bounds the broadcast and a task's memory
ROWS_AT_ONCE = 2048

CODES = "vec_id long, dim int, code binary, quality double, embedding array<double>"
NEAR = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """``dim`` orthonormal rows in ``dim * SPREAD`` dimensions: a random rotation of the padded space."""
    gauss = np.random.default_rng([seed, dim]).standard_normal((dim * SPREAD, dim))
    return np.linalg.qr(gauss)[0].T.copy()


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, packed; and the cosine of each with its signs' direction."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    turned = unit @ turn
    quality = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned >= 0, axis=1), quality


def bounds(codes: np.ndarray, quality: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit ``queries`` (rows) with coded vectors (columns), and their errors.

    The inner product of the query with a vector's signs, divided by that vector's own, is an
    unbiased estimate; its error shrinks with the square root of the number of bits.
    """
    bits = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * np.float32(2) - np.float32(1)
    turned = (queries @ turn).astype(np.float32)
    inner = (turned @ signs.T) / np.float32(np.sqrt(bits))
    own = quality.astype(np.float32)
    error = EPSILON * np.sqrt((1 - np.minimum(quality, 1) ** 2) / quality ** 2 / (bits - 1)).astype(np.float32)
    return inner / own, error


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is neither null, empty nor zero and has finite parts only."""
    parts = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def index(vectors: DataFrame) -> DataFrame:
    """Code, correction scalar and original vector of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            codes: list[bytes] = [b""] * len(sizes)
            quality = np.zeros(len(sizes))
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                rows = flat[starts[own][:, None] + np.arange(dim)]
                turn = turns.setdefault(int(dim), rotation(int(dim)))
                packed, quality[own] = encode(scaled(rows), turn)
                for i, c in zip(own.tolist(), packed):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary()), pa.array(quality), column],
                names=["vec_id", "dim", "code", "quality", "embedding"])

    return usable(vectors).mapInArrow(run, CODES)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their largest part, so that squares of huge or tiny parts stay finite."""
    return rows / np.abs(rows).max(axis=1)[:, None]


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines of paired rows, in double precision.

    Rows are first multiplied by a power of two that brings their largest part near 1: that leaves
    ordinary scores as they are, and squares of huge or tiny parts finite.
    """
    queries, rows = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (queries, rows))
    dot = np.einsum("ij,ij->i", queries, rows)
    return dot / (np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", rows, rows)))


def search(coded: DataFrame, queries: DataFrame, k: int = K, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The ``k`` nearest rows of the written table ``coded`` for every row of ``queries``.

    Queries go in blocks of about ``at_once`` rows, each broadcast and held against all codes. A
    task keeps the vectors whose upper bound reaches the k-th best lower bound it has seen, takes
    their exact cosines, and passes on its best k of each query. A query's own id is no candidate,
    nor are vectors of another dimension. Ties go to the smaller id; rows that repeat an id are
    candidates of their own, and of repeated query ids the first vector (by its parts) counts.
    """
    spark = coded.sparkSession
    first = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = settle(first.select("vec_id", F.size("embedding").alias("dim"), "embedding"))
    n = max(1, -(-first.count() // at_once))
    out: DataFrame | None = None
    for i in range(n):
        block = first.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).orderBy("vec_id").collect()
        table = {}
        for dim in sorted({r["dim"] for r in block}):
            own = [r for r in block if r["dim"] == dim]
            table[dim] = (np.array([r["vec_id"] for r in own]), np.array([r["embedding"] for r in own], dtype=np.float64))
        found = settle(_best(_scan(coded, spark.sparkContext.broadcast(table), k), k))
        out = found if out is None else out.unionByName(found)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(coded: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {dim: rotation(dim) for dim in shared.value}
        units = {dim: v / np.sqrt((v * v).sum(axis=1))[:, None] for dim, v in
                 ((d, scaled(q)) for d, (_, q) in shared.value.items())}
        kept: dict[int, list[list[tuple[float, int]]]] = {d: [[] for _ in ids] for d, (ids, _) in shared.value.items()}
        floor = {d: np.full(len(ids), -np.inf) for d, (ids, _) in shared.value.items()}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in shared.value:
                    continue
                ids, vectors = shared.value[int(dim)]
                turn, unit, best, low = turns[int(dim)], units[int(dim)], kept[int(dim)], floor[int(dim)]
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), ROWS_AT_ONCE):
                    take = batch.take(pa.array(own[at:at + ROWS_AT_ONCE]))
                    vec = take.column(0).to_numpy()
                    codes = np.frombuffer(b"".join(take.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)
                    quality = take.column(3).to_numpy()
                    rows = take.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
                    for q in range(0, len(ids), 512):
                        _block(ids[q:q + 512], vectors[q:q + 512], unit[q:q + 512], turn, vec, codes, quality, rows,
                               best[q:q + 512], low[q:q + 512], k)
        for dim, (ids, _) in shared.value.items():
            triples = [(int(i), v, s) for i, own in zip(ids, kept[dim]) for s, v in own]
            columns = [list(c) for c in zip(*triples)] if triples else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return coded.mapInArrow(run, NEAR)


def _block(ids, vectors, unit, turn, vec, codes, quality, rows, best, low, k) -> None:
    """Hold some queries against some rows; ``best`` and ``low`` (k-th best so far) are changed."""
    estimate, error = bounds(codes, quality, unit, turn)
    estimate[ids[:, None] == vec[None, :]] = -np.inf
    lower = estimate - error
    if lower.shape[1] > k:
        kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k]
    else:
        kth = np.full(len(ids), -np.inf)
    reach = np.maximum(kth, low)
    a, b = np.nonzero((estimate + error >= reach[:, None]) & (estimate > -np.inf))
    if not len(a):
        return
    exact = cosines(vectors[a], rows[b])
    order = np.lexsort((vec[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    ends = np.flatnonzero(np.diff(a, append=-1)) + 1
    begin = 0
    for end in ends.tolist():
        i = int(a[begin])
        last = min(end, begin + k)
        own = best[i] + list(zip(exact[begin:last].tolist(), vec[b[begin:last]].tolist()))
        own.sort(key=lambda x: (-x[0], x[1]))
        del own[k:]
        best[i][:] = own
        if len(own) == k:
            low[i] = max(low[i], own[-1][0])
        begin = end


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded = settle(index(vectors))
    return search(coded, usable(vectors).filter("vec_id % 50 = 0")).select(
        F.col("query_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
