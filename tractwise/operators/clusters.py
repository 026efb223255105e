"""k-means and Gaussian mixtures by repeated passes over the vectors.

Every start (k-means) or every model (number of clusters x covariance family) is advanced in the
same pass: a partition returns its sums per model, Spark adds them, and only the new centres,
bounded by clusters x bins (x bins, where covariances are fitted), come back to the driver. The
plan of a pass never grows.

A family has three letters, for the volume, the shape and the axes of its ellipsoids: E is equal in
all clusters, V varies, I stands for a sphere (shape) or for the axes of the bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tractwise.operators.bins import BinGrid, bin_means, fit_grid, scale_vectors, vector_stats
from tractwise.params import (BIN_TAU, BIN_WIDTH, MAX_CLUSTERS, MAX_ITER, N_CLUSTERS, N_START)
from tractwise.session import settle

# covariance families, simplest first; the first one wins a tie
FAMILIES = ["EII", "VII", "EEI", "VEI", "EVI", "VVI"]
FULL_FAMILIES = ["EEE", "VEE", "EEV", "VEV", "EVV", "VVV"]
# different shapes on common axes, which settle over hundreds of passes: fitted where they are named
COMMON_AXES = ["EVE", "VVE"]
TINY = np.finfo(float).eps
#: A covariance whose smallest eigenvalue is below this share of the largest one is singular.
SINGULAR = 1e-12
#: Vectors in one partition of packed blocks, and in one step over a block, whose tables fit a processor's cache.
PACKED_ROWS, STEP_ROWS = 1 << 16, 1024
#: Numbers that the partitions of a pass may send to the driver; beyond it Spark adds them up.
DIRECT_SUMS = 1 << 21
#: Steps of the common axes (EVE, VVE) in one pass; the next pass goes on from there.
AXIS_STEPS = 20


def has_axes(family: str | None) -> bool:
    """Whether the family has covariances and not only variances."""
    return family is not None and family[2] != "I"


@dataclass
class _Candidate:
    """One start or one mixture being fitted."""

    name: int
    means: np.ndarray
    family: str | None = None
    variances: np.ndarray | None = None
    weights: np.ndarray | None = None
    axes: np.ndarray | None = None
    goal: float = np.inf
    bic: float = -np.inf
    done: bool = False
    failed: bool = False
    status: str = "ok"
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.means)


def log_densities(x: np.ndarray, means: np.ndarray, variances: np.ndarray,
                  weights: np.ndarray) -> np.ndarray:
    """Log of weight times density for every row and component.

    ``variances`` is clusters x bins, or clusters x bins x bins for whole covariances.
    """
    if variances.ndim == 3:
        roots = np.linalg.cholesky(variances)
        square = np.stack([(((x - m) @ np.linalg.inv(r).T) ** 2).sum(1)
                           for m, r in zip(means, roots)], 1)
        spread = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1)
        return np.log(weights) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + spread) - 0.5 * square
    inverse = 1 / variances
    square = (x * x) @ inverse.T - 2 * x @ (means * inverse).T + (means * means * inverse).sum(1)
    constant = np.log(weights) - 0.5 * np.log(2 * np.pi * variances).sum(1)
    return constant - 0.5 * square


def responsibilities(x: np.ndarray, model: _Candidate) -> tuple[np.ndarray, float]:
    """Soft memberships and log-likelihood, or hard ones and the sum of squares."""
    if model.variances is None:
        far = ((x * x).sum(1)[:, None] - 2 * x @ model.means.T
               + (model.means * model.means).sum(1))
        own = far.argmin(1)
        gap = x - model.means[own]
        return np.eye(model.k)[own], float((gap * gap).sum())
    logs = log_densities(x, model.means, model.variances, model.weights)
    top = logs.max(1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
    return np.exp(logs - total), float(total.sum())


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


@contextmanager
def _packed(vectors: DataFrame, vec: str) -> Iterator[DataFrame]:
    """The vectors as blocks of raw doubles, which the executors keep while models are fitted.

    A pass reads them without turning a list into a row or a row into a list.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = batch.column(0)
                if cells.null_count or len(cells.value_lengths().unique()) > 1:
                    raise ValueError("vectors must have the same length")
                values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                for part in np.array_split(values.reshape(batch.num_rows, -1), -(-batch.num_rows // 4096)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                        ["n", "block"])

    parts = max(1, -(-vectors.count() // STEP_ROWS))
    least = -(-parts * STEP_ROWS // PACKED_ROWS)
    parts = max(least, min(parts, vectors.sparkSession.sparkContext.defaultParallelism))
    blocks = vectors.select(F.col(vec).cast("array<double>").alias(vec)).repartition(parts).mapInArrow(
        pack, "n long, block binary").persist(StorageLevel.MEMORY_AND_DISK)
    blocks._parts = parts
    try:
        yield blocks
    finally:
        blocks.unpersist()


def _steps(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, block in zip(batch.column("n").to_pylist(), batch.column("block")):
            x = np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(n, -1)
            for i in range(0, n, rows):
                yield x[i:i + rows]


def _second_moments(x: np.ndarray, z: np.ndarray, whole: bool) -> np.ndarray:
    """Weighted sums of squares per cluster, or of the products of all pairs of bins."""
    if not whole:
        return z.T @ (x * x)
    upper = np.triu_indices(x.shape[1])
    roots = [x * w[:, None] for w in np.sqrt(z.T)]
    return np.stack([(r.T @ r)[upper] for r in roots])


def _nearest_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Members and sums per centre, then the sum of squares, of every start (starts x k x bins)."""
    many, k, p = centers.shape
    flat = centers.reshape(many * k, p)
    gap = ((flat * flat).sum(1)[:, None] / 2 - flat @ x.T).reshape(many, k, len(x))
    best, own = gap[:, 0], np.zeros((many, len(x)), dtype=np.int32)
    for c in range(1, k):
        nearer = gap[:, c] < best
        best, own = np.where(nearer, gap[:, c], best), np.where(nearer, np.int32(c), own)
    onto = (own[:, None, :] == np.arange(k, dtype=np.int32)[None, :, None]).astype(float)
    sums = onto.reshape(many * k, len(x)) @ x
    goal = np.maximum(2 * best + (x * x).sum(1), 0.0).sum(1)
    return np.concatenate([onto.sum(2), sums.reshape(many, k * p), goal[:, None]], 1)


def _add_up(blocks: DataFrame, sums: dict[int, int], rows: int, step) -> dict[int, np.ndarray]:
    """What ``step`` returns for every model of ``sums`` (its length), added over all blocks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x in _steps(batches, rows):
            for name, flat in step(x):
                total[name] = total[name] + flat if name in total else flat
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                ["model", "sums"])

    found = blocks.mapInArrow(partial, "model int, sums array<double>")
    out = {name: np.zeros(length) for name, length in sums.items()}
    if sum(sums.values()) * blocks._parts <= DIRECT_SUMS:
        table = found.toArrow()
        for name, flat in zip(table.column("model").to_pylist(), table.column("sums")):
            out[name] += flat.values.to_numpy()
        return out
    # summed per position, so partial sums combine on the map side and no cell grows with the tasks
    table = found.select("model", F.posexplode("sums").alias("pos", "value")).groupBy("model", "pos").agg(
        F.sum("value").alias("value")).toArrow()
    name, pos, value = (table.column(c).to_numpy() for c in ("model", "pos", "value"))
    for m in out:
        out[m][pos[name == m]] = value[name == m]
    return out


def _pass(blocks: DataFrame, models: Sequence[_Candidate]) -> dict[int, tuple]:
    """One scan: per model the member counts, sums, second moments and the objective."""

    def step(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for m in models:
            z, goal = responsibilities(x, m)
            second = _second_moments(x, z, has_axes(m.family))
            yield m.name, np.concatenate([z.sum(0), (z.T @ x).ravel(), second.ravel(), [goal]])

    lengths = {}
    for m in models:
        k, p = m.means.shape
        lengths[m.name] = k + k * p + k * (p * (p + 1) // 2 if has_axes(m.family) else p) + 1
    sums = _add_up(blocks, lengths, 4 * STEP_ROWS, step)
    out = {}
    for m in models:
        flat = sums[m.name]
        k, p = m.means.shape
        second = flat[k + k * p:-1].reshape(k, -1)
        if has_axes(m.family):
            upper, half = np.triu_indices(p), second
            second = np.empty((k, p, p))
            second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = half
        out[m.name] = (flat[:k], flat[k:k + k * p].reshape(k, p), second, flat[-1])
    return out


def _means_pass(blocks: DataFrame, models: Sequence[_Candidate]) -> dict[int, tuple]:
    """One scan of k-means: per start the member counts, sums and the sum of squares."""
    groups = {k: [m for m in models if m.k == k] for k in {m.k for m in models}}
    centers = {k: ([m.name for m in same], np.stack([m.means for m in same])) for k, same in groups.items()}

    def step(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for names, means in centers.values():
            yield from zip(names, _nearest_sums(x, means))

    sums = _add_up(blocks, {m.name: m.means.size + m.k + 1 for m in models}, STEP_ROWS, step)
    return {m.name: (sums[m.name][:m.k], sums[m.name][m.k:-1].reshape(m.means.shape), sums[m.name][-1])
            for m in models}


def _start_rows(vectors: DataFrame, vec: str, size: int, seed: int) -> np.ndarray:
    """A reproducible pool of start rows: the distinct vectors of smallest hashes, ``size`` at most."""
    order = F.xxhash64(F.col(vec), F.lit(seed))
    rows = vectors.select(vec).distinct().orderBy(order, vec).limit(size).collect()
    return np.array([r[vec] for r in rows], dtype=float)


def _run_kmeans(blocks: DataFrame, starts: list[np.ndarray], max_iter: int) -> list[_Candidate]:
    models = [_Candidate(i, s.copy()) for i, s in enumerate(starts)]
    for _ in range(max_iter):
        live = [m for m in models if not m.done]
        if not live:
            break
        found = _means_pass(blocks, live)
        for m in live:
            size, sums, goal = found[m.name]
            fresh = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], m.means)
            m.done = bool(np.abs(fresh - m.means).max() <= 1e-9)
            m.means, m.goal, m.weights = fresh, goal, None
    return models


def kmeans_fit(vectors: DataFrame, k: int = N_CLUSTERS, n_start: int = N_START,
               max_iter: int = MAX_ITER, seed: int = 42, vec: str = "z") -> _Candidate:
    """Best of ``n_start`` starts by the within-cluster sum of squares."""
    k = max(2, min(k, vectors.count()))
    pool = _start_rows(vectors, vec, n_start * k, seed)
    if len(pool) < k:
        raise ValueError("more clusters than distinct vectors")
    rng = np.random.default_rng(seed)
    starts = [pool[rng.choice(len(pool), k, replace=False)] for _ in range(n_start)]
    with _packed(vectors, vec) as blocks:
        return min(_run_kmeans(blocks, starts, max_iter), key=lambda m: m.goal)


def family_variances(family: str, size: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Maximum-likelihood variances (clusters x bins) of one family from the scatter diagonals."""
    k, p = scatter.shape
    n = size.sum()
    if family == "EII":
        return np.full((k, p), scatter.sum() / (n * p))
    if family == "VII":
        return np.repeat((scatter.sum(1) / (size * p))[:, None], p, 1)
    if family == "EEI":
        return np.repeat((scatter.sum(0) / n)[None, :], k, 0)
    if family == "VVI":
        return scatter / size[:, None]
    if family == "EVI":
        root = np.exp(np.log(scatter).mean(1))
        return scatter / root[:, None] * (root.sum() / n)
    if family == "VEI":
        volume = scatter.sum(1) / (size * p)
        shape = np.ones(p)
        for _ in range(100):
            raw = (scatter / volume[:, None]).sum(0)
            fresh = raw / np.exp(np.log(raw).mean())
            volume = (scatter / fresh).sum(1) / (size * p)
            if np.abs(fresh - shape).max() < 1e-8:
                break
            shape = fresh
        return volume[:, None] * fresh[None, :]
    raise ValueError(f"unknown family: {family}")


def _common_axes(family: str, size: np.ndarray, scatter: np.ndarray,
                 axes: np.ndarray) -> np.ndarray:
    """Better common axes of clusters of different shapes.

    Each step replaces the concave part of the criterion by its tangent, whose best axes follow
    from a singular value decomposition, so that the likelihood never falls (Browne and McNicholas 2014).
    """
    largest = np.linalg.eigvalsh(scatter)[:, -1]
    for _ in range(AXIS_STEPS):
        along = np.einsum("ia,kij,ja->ka", axes, scatter, axes)
        inverse = 1 / family_variances(family[:2] + "I", size, along)
        tangent = (np.einsum("ka,ja,kji->ai", inverse, axes, scatter)
                   - np.einsum("ka,ia,k->ai", inverse, axes, largest))
        left, _, right = np.linalg.svd(tangent)
        fresh = -(left @ right).T
        moved = 1 - np.abs((fresh * axes).sum(0)).min()
        axes = fresh
        if moved < 1e-12:
            break
    return axes


def family_covariances(family: str, size: np.ndarray, scatter: np.ndarray,
                       axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum-likelihood covariances of one family from the scatter matrices.

    The second result holds the common axes of EVE and VVE, which take several passes to settle.
    """
    k, p, _ = scatter.shape
    inner = family[:2] + "I"
    if family[2] == "V":
        along, own = np.linalg.eigh(scatter)
        spread = family_variances(inner, size, along)
        return np.einsum("kia,ka,kja->kij", own, spread, own), None
    if family == "EEE":
        return np.repeat((scatter.sum(0) / size.sum())[None], k, 0), None
    if family == "VEE":
        volume = np.trace(scatter, axis1=1, axis2=2) / (size * p)
        shape = np.eye(p)
        for _ in range(100):
            raw = (scatter / volume[:, None, None]).sum(0)
            fresh = raw / np.exp(np.linalg.slogdet(raw)[1] / p)
            volume = np.einsum("kij,ji->k", scatter, np.linalg.inv(fresh)) / (size * p)
            done = np.abs(fresh - shape).max() < 1e-8
            shape = fresh
            if done:
                break
        return volume[:, None, None] * shape, None
    if family in COMMON_AXES:
        if axes is None:
            axes = np.linalg.eigh(scatter.sum(0))[1]
        axes = _common_axes(family, size, scatter, axes)
        along = np.einsum("ia,kij,ja->ka", axes, scatter, axes)
        spread = family_variances(inner, size, along)
        return np.einsum("ia,ka,ja->kij", axes, spread, axes), axes
    raise ValueError(f"unknown family: {family}")


def family_parameters(family: str, k: int, p: int) -> int:
    """Free parameters: means, weights, volumes, shapes and axes."""
    volume = 1 if family[0] == "E" else k
    shape = {"I": 0, "E": p - 1, "V": k * (p - 1)}[family[1]]
    axes = {"I": 0, "E": 1, "V": k}[family[2]] * p * (p - 1) // 2
    return k * p + (k - 1) + volume + shape + axes


def _usable(variances: np.ndarray) -> bool:
    if not np.isfinite(variances).all():
        return False
    if variances.ndim == 2:
        return bool(variances.min() > TINY)
    values = np.linalg.eigvalsh(variances)
    return bool((values[:, 0] > np.maximum(TINY, SINGULAR * values[:, -1])).all())


def _maximise(m: _Candidate, size: np.ndarray, sums: np.ndarray, second: np.ndarray) -> None:
    """New parameters from the sums of a pass; a cluster without members or spread ends the model."""
    axes = variances = None
    if size.min() > TINY:
        means = sums / size[:, None]
        with np.errstate(all="ignore"):
            try:
                if has_axes(m.family):
                    scatter = second - size[:, None, None] * means[:, :, None] * means[:, None, :]
                    variances, axes = family_covariances(m.family, size, scatter, m.axes)
                else:
                    squares = second if second.ndim == 2 else np.diagonal(second, axis1=1, axis2=2)
                    scatter = np.maximum(squares - size[:, None] * means * means, 0.0)
                    variances = family_variances(m.family, size, scatter)
            except np.linalg.LinAlgError:
                variances = None
    if variances is None or not _usable(variances):
        m.failed = m.done = True
        m.status, m.bic = "failed", -np.inf
        return
    m.means, m.variances, m.weights, m.axes = means, variances, size / size.sum(), axes


def _grow(blocks: DataFrame, partitions: Sequence[_Candidate], families: Sequence[str],
          n: int, tol: float, max_iter: int) -> list[_Candidate]:
    """EM of every family from the members of each partition, all models in the same passes."""
    if any(map(has_axes, families)):
        partitions = [replace(run, family="VVV") for run in partitions]
    hard = _pass(blocks, partitions)
    models = []
    for run in partitions:
        for family in families:
            m = _Candidate(len(models), run.means.copy(), family)
            _maximise(m, *hard[run.name][:3])
            models.append(m)
    for _ in range(max_iter):
        live = [m for m in models if not m.done]
        if not live:
            break
        found = _pass(blocks, live)
        for m in live:
            size, sums, second, loglik = found[m.name]
            p = m.means.shape[1]
            m.history.append(loglik)
            if not np.isfinite(loglik):
                m.failed = m.done = True
                m.status = "failed"
                continue
            m.bic = 2 * loglik - family_parameters(m.family, m.k, p) * np.log(n)
            if abs(loglik - m.goal) / (1 + abs(loglik)) < tol:
                m.done = True
                m.goal = loglik
            else:
                m.goal = loglik
                _maximise(m, size, sums, second)
    for m in models:
        if not m.done:
            m.status = "not converged"
    return models


def kmeans_from(vectors: DataFrame, centers: np.ndarray, max_iter: int = MAX_ITER,
                vec: str = "z") -> _Candidate:
    """k-means from given centres; a centre without members stays where it is."""
    with _packed(vectors, vec) as blocks:
        return _run_kmeans(blocks, [np.asarray(centers, dtype=float)], max_iter)[0]


def mixture_from(vectors: DataFrame, centers: np.ndarray, family: str, max_iter: int = 500,
                 tol: float = 1e-5, vec: str = "z") -> _Candidate:
    """EM of one family, which starts with the members nearest to given centres."""
    run = _Candidate(0, np.asarray(centers, dtype=float))
    with _packed(vectors, vec) as blocks:
        return _grow(blocks, [run], [family], vectors.count(), tol, max_iter)[0]


def mixture_fits(vectors: DataFrame, ks: Sequence[int], families: Sequence[str] | None = None,
                 n_start: int = 5, tol: float = 1e-5, max_iter: int = 500, seed: int = 42,
                 vec: str = "z") -> list[_Candidate]:
    """EM for every number of clusters and family, started from k-means partitions.

    Without ``families`` all but those of common axes are fitted where there are more vectors than
    bins, else the ones without covariances.
    Every asked number has its models in the result. ``status`` says what became of each: ok,
    failed, not converged (after ``max_iter`` passes) or fewer distinct vectors than clusters.
    """
    n, asked = vectors.count(), list(ks)
    pool = _start_rows(vectors, vec, n_start * max(ks), seed)
    ks = [k for k in asked if k <= len(pool)]
    rng = np.random.default_rng(seed)
    starts = [pool[rng.choice(len(pool), k, replace=False)] for k in ks for _ in range(n_start)]
    if families is None:
        bins = pool.shape[1] if len(pool) else 0
        families = FAMILIES + FULL_FAMILIES if n > bins else FAMILIES
    with _packed(vectors, vec) as blocks:
        runs = _run_kmeans(blocks, starts, 100)
        best = [min((r for r in runs if r.k == k), key=lambda r: r.goal) for k in ks]
        models = _grow(blocks, best, families, n, tol, max_iter)
    models += [_Candidate(-1, np.empty((k, 0)), family, done=True, failed=True,
                          status="fewer distinct vectors")
               for k in asked if k > len(pool) for family in families]
    return models


def bic_table(spark: SparkSession, models: Sequence[_Candidate]) -> DataFrame:
    rows = [(m.family, m.k, None if m.failed else float(m.goal), None if m.failed else float(m.bic),
             m.status) for m in models]
    return spark.createDataFrame(rows, "family string, k int, loglik double, bic double, status string")


@dataclass
class ClusterModel:
    """A fitted model. Its size is bounded by clusters x bins."""

    method: str
    tau: float
    grid: BinGrid
    mean: np.ndarray
    sd: np.ndarray
    centers_s: np.ndarray
    family: str | None = None
    variances: np.ndarray | None = None
    weights: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.centers_s)

    @property
    def centers(self) -> np.ndarray:
        return self.centers_s * self.sd + self.mean

    @property
    def types(self) -> list[str]:
        means = self.centers.mean(1)
        return ["expansion-dominant" if m > self.tau else "contraction-dominant" if m < -self.tau
                else "neutral-like" for m in means]


def train_model(points: DataFrame, method: str = "gmm", k: int = N_CLUSTERS,
                auto_select_k: bool = True, bin_width: float = BIN_WIDTH, tau: float = BIN_TAU,
                seed: int = 42, key: str = "file", **options) -> ClusterModel:
    """Bins, scales and clusters the training files (long form: key, x, delta)."""
    grid = fit_grid(points, bin_width)
    vectors = settle(bin_means(points, grid, key))
    stats = sorted(vector_stats(vectors).collect(), key=lambda r: r["bin"])
    mean = np.array([r["mean"] for r in stats])
    sd = np.array([r["sd"] for r in stats])
    scaled = scale_vectors(vectors, _stats_frame(points.sparkSession, mean, sd)).select(key, "z")
    scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = scaled.count()
        if method == "kmeans":
            fit = kmeans_fit(scaled, k, seed=seed, **options)
        elif method == "gmm":
            top = max(2, min(MAX_CLUSTERS, n - 1))
            ks = range(1, top + 1) if auto_select_k else [max(2, min(k, n - 1))]
            fits = mixture_fits(scaled, list(ks), seed=seed, **options)
            fit = max(fits, key=lambda m: m.bic, default=None)
            if fit is None or fit.failed:
                raise ValueError("no mixture could be fitted")
        else:
            raise ValueError(f"unknown method: {method}")
    finally:
        scaled.unpersist()
    return ClusterModel(method, tau, grid, mean, sd, fit.means, fit.family, fit.variances, fit.weights)


def _stats_frame(spark: SparkSession, mean: np.ndarray, sd: np.ndarray) -> DataFrame:
    rows = [(i + 1, float(m), float(s)) for i, (m, s) in enumerate(zip(mean, sd))]
    return spark.createDataFrame(rows, "bin int, mean double, sd double")


def model_stats(spark: SparkSession, model: ClusterModel) -> DataFrame:
    return _stats_frame(spark, model.mean, model.sd)


def score_vectors(vectors: DataFrame, model: ClusterModel, vec: str = "z") -> DataFrame:
    """Add cluster, cluster_type, probs and the predicted delta per bin, in Arrow batches."""
    centers, scaled = model.centers, model.centers_s
    variances, weights = model.variances, model.weights
    types = np.array(model.types)
    hard = model.method == "kmeans"

    def score(column: pd.Series) -> pd.DataFrame:
        x = _stack(column)
        if hard:
            dist2 = ((x[:, None, :] - scaled[None, :, :]) ** 2).sum(2)
            own = dist2.argmin(1)
            probs = 1 / (dist2 + 1e-6)
            probs /= probs.sum(1, keepdims=True)
            pred = centers[own]
        else:
            logs = log_densities(x, scaled, variances, weights)
            probs = np.exp(logs - logs.max(1, keepdims=True))
            probs /= probs.sum(1, keepdims=True)
            own = probs.argmax(1)
            pred = probs @ centers
        return pd.DataFrame({"cluster": own + 1, "cluster_type": types[own], "probs": list(probs),
                             "pred": list(pred)})

    scorer = F.pandas_udf(score, "cluster int, cluster_type string, probs array<double>, "
                                 "pred array<double>")
    return vectors.withColumn("_s", scorer(F.col(vec))).select("*", "_s.*").drop("_s")


def file_vectors(points: DataFrame, model: ClusterModel, key: str = "file") -> DataFrame:
    """Binned, scaled and scored files."""
    vectors = bin_means(points, model.grid, key)
    scaled = scale_vectors(vectors, model_stats(points.sparkSession, model))
    return score_vectors(scaled, model)


def train_assignments(points: DataFrame, model: ClusterModel, key: str = "file") -> DataFrame:
    return file_vectors(points, model, key).select(
        key, "cluster", "cluster_type",
        *[F.col("probs")[i].alias(f"pC{i + 1}") for i in range(model.k)])


def bin_predictions(points: DataFrame, model: ClusterModel, key: str = "file") -> DataFrame:
    """Observed and predicted delta of every file and bin."""
    return predicted_bins(file_vectors(points, model, key), model, key)


def predicted_bins(scored: DataFrame, model: ClusterModel, key: str = "file") -> DataFrame:
    """The cells of files that are scored already."""
    cells = F.arrays_zip(F.col("vec").alias("y_bin"), F.col("pred").alias("y_pred"))
    return scored.select(key, "cluster", "cluster_type", F.posexplode(cells).alias("_i", "_c")).select(
        key, (F.col("_i") + 1).alias("bin"),
        (F.lit(model.grid.start) + (F.col("_i") + 0.5) * model.grid.width).alias("mid"),
        "_c.y_bin", "_c.y_pred", "cluster", "cluster_type")


def center_frame(spark: SparkSession, model: ClusterModel) -> DataFrame:
    """bin_1 .. bin_p, cluster, cluster_type: the centres on the original scale."""
    names = [f"bin_{i + 1}" for i in range(model.grid.count)]
    rows = [(*map(float, c), i + 1, t) for i, (c, t) in enumerate(zip(model.centers, model.types))]
    schema = ", ".join(f"{n} double" for n in names) + ", cluster int, cluster_type string"
    return spark.createDataFrame(rows, schema)


def save_model(spark: SparkSession, model: ClusterModel, folder: str) -> str:
    """Three parquet tables below ``unsup_model_<method>_K<k>``; returns that path."""
    path = f"{folder.rstrip('/')}/unsup_model_{model.method}_K{model.k}"
    meta = [(model.method, model.k, float(model.tau), model.grid.start, model.grid.width,
             model.grid.count, model.family)]
    spark.createDataFrame(
        meta, "method string, k int, tau double, bin_start double, bin_width double, bins int, "
              "family string").write.mode("overwrite").parquet(f"{path}/meta")
    model_stats(spark, model).join(model.grid.frame(spark), "bin").write.mode(
        "overwrite").parquet(f"{path}/bins")

    def values(row: np.ndarray | None) -> list[float] | None:
        return None if row is None else [float(v) for v in row]

    centers = [
        (i + 1, values(model.centers_s[i]), values(model.centers[i]),
         values(None if model.variances is None else model.variances[i].ravel()),
         None if model.weights is None else float(model.weights[i]), model.types[i])
        for i in range(model.k)
    ]
    spark.createDataFrame(
        centers, "cluster int, center_s array<double>, center array<double>, "
                 "variance array<double>, weight double, cluster_type string"
    ).write.mode("overwrite").parquet(f"{path}/centers")
    return path


def load_model(spark: SparkSession, path: str) -> ClusterModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    bins = spark.read.parquet(f"{path}/bins").sort("bin").collect()
    centers = spark.read.parquet(f"{path}/centers").sort("cluster").collect()
    soft = centers[0]["variance"] is not None
    shape = (-1, meta["bins"], meta["bins"]) if has_axes(meta["family"]) else (-1, meta["bins"])
    return ClusterModel(
        meta["method"], meta["tau"], BinGrid(meta["bin_start"], meta["bin_width"], meta["bins"]),
        np.array([b["mean"] for b in bins]), np.array([b["sd"] for b in bins]),
        np.array([c["center_s"] for c in centers]), meta["family"],
        np.array([c["variance"] for c in centers]).reshape(shape) if soft else None,
        np.array([c["weight"] for c in centers]) if soft else None)
