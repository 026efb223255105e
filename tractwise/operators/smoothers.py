"""Penalised-spline fits and change points of many series per Arrow batch.

A series holds at most one point per repeat length up to ``max_length``, so it travels as two
short arrays. Series that share their lengths share one spline basis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.functions.columns import agreed_label, band_label, tau_label
from tractwise.operators.series import rolling_mean, smooth
from tractwise.params import K_SPLINE, MAX_LENGTH, SEGMENT_TAU, SMOOTH_K

Z95 = 1.959963984540054  # 97.5 % quantile of the standard normal
#: Series of one batch that are worked on at once, which bounds a task's tables.
AT_ONCE = 256


def basis_size(n: int, k_spline: int = K_SPLINE) -> int:
    return max(10, min(k_spline, n // 4))


class SplineBasis:
    """Thin-plate regression spline of one variable, rotated so that the penalty is diagonal.

    The space is a straight line plus the leading eigenvectors of the |r|^3 kernel (Wood 2003).
    ``line`` and ``wave`` are orthonormal columns; for a smoothing parameter, ``wave`` column i is
    shrunk by s_i^2 / (s_i^2 + lambda).
    """

    def __init__(self, x: np.ndarray, k: int):
        points, where = np.unique(x, return_inverse=True)
        if len(points) < k:
            raise ValueError(f"{len(points)} distinct lengths, {k} needed")
        gap = points - points.mean()
        kernel = np.abs(gap[:, None] - gap[None, :]) ** 3 / 12
        values, vectors = np.linalg.eigh(kernel)
        lead = np.argsort(-np.abs(values))[:k]
        d, u = values[lead], vectors[:, lead]
        trend = np.column_stack([np.ones(len(points)), gap])
        free = np.linalg.qr(u.T @ trend, mode="complete")[0][:, 2:]
        penalty = free.T @ (d[:, None] * free)
        chol = np.linalg.cholesky((penalty + penalty.T) / 2)
        radial = np.linalg.solve(chol, ((u * d) @ free).T).T[where]
        self.line = np.linalg.qr(trend[where])[0]
        bent = radial - self.line @ (self.line.T @ radial)
        left, single, _ = np.linalg.svd(bent, full_matrices=False)
        keep = single > single.max() * 1e-10
        self.wave, self.s2 = left[:, keep], single[keep] ** 2
        self.n = len(x)

    def shrink(self, log_lambda: np.ndarray) -> np.ndarray:
        return self.s2 / (self.s2 + np.exp(log_lambda)[:, None])

    def fit(self, y: np.ndarray):
        """REML fits of all columns of y: fitted values, standard errors, edf, log lambda."""
        level = self.line @ (self.line.T @ y)
        waves = self.wave.T @ y
        energy = waves * waves
        floor = np.maximum(((y - level) ** 2).sum(0) - energy.sum(0), 0.0)
        free = self.n - 2

        def criterion(log_lambda: np.ndarray) -> np.ndarray:
            kept = 1 - self.shrink(log_lambda)
            quad = (kept * energy.T).sum(1) + floor
            return free * np.log(np.maximum(quad, 1e-300)) - np.log(kept).sum(1)

        center = np.log(self.s2)
        grid = np.linspace(center.min() - 12, center.max() + 12, 81)
        table = np.stack([criterion(np.full(y.shape[1], g)) for g in grid])
        at = table.argmin(0)
        low = grid[np.maximum(at - 1, 0)]
        high = grid[np.minimum(at + 1, len(grid) - 1)]
        ratio = (np.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            left_better = criterion(a) < criterion(b)
            high, low = np.where(left_better, b, high), np.where(left_better, low, a)
        log_lambda = (low + high) / 2
        kept = self.shrink(log_lambda)
        fitted = level + self.wave @ (kept.T * waves)
        edf = 2 + kept.sum(1)
        sigma2 = ((y - fitted) ** 2).sum(0) / np.maximum(self.n - edf, 1e-9)
        unit = self.unit_variance(kept)
        return fitted, np.sqrt(unit * sigma2), edf, log_lambda, kept

    def unit_variance(self, kept: np.ndarray) -> np.ndarray:
        return (self.line ** 2).sum(1)[:, None] + (self.wave ** 2) @ kept.T

    def simultaneous(self, kept: np.ndarray, normals: np.ndarray) -> float:
        """95 % quantile of the largest standardised deviation over the lengths of one series.

        ``normals`` has a row for each column of the line and the waves, and a column for each draw.
        """
        scale = np.sqrt(self.unit_variance(kept[None, :])[:, 0])
        weights = np.column_stack([self.line, self.wave * np.sqrt(kept)]) / scale[:, None]
        largest = np.empty(normals.shape[1])
        for i in range(0, len(largest), 1024):
            paths = weights @ normals[:, i:i + 1024]
            largest[i:i + 1024] = np.maximum(paths.max(0), -paths.min(0))
        return float(np.quantile(largest, 0.95))


def _series_arrays(series: DataFrame, *values: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("x", *values)))
    packed = series.groupBy("dataset").agg(rows.alias("_p"))
    return packed.select("dataset", *[F.col(f"_p.{c}").alias(c) for c in ("x", *values)])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            yield batch.iloc[i:i + AT_ONCE]


def _same_lengths(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[int]]]:
    groups: dict[bytes, list[int]] = {}
    lengths = [np.asarray(x, dtype=float) for x in batch["x"]]
    for i, x in enumerate(lengths):
        groups.setdefault(x.tobytes(), []).append(i)
    for rows in groups.values():
        yield lengths[rows[0]], rows


def _copies(x: np.ndarray) -> np.ndarray:
    """How many earlier points of a sorted series have the same length."""
    return np.arange(len(x)) - np.searchsorted(x, x)


FIT_SCHEMA = ("dataset string, x double, copy int, delta double, yf double, fit double, se double, "
              "lower double, upper double, k_spline int, edf double, log_lambda double, status string")


def spline_fit(series: DataFrame, k_spline: int = K_SPLINE, smooth_k: int = SMOOTH_K,
               max_length: float = MAX_LENGTH, tau: float = SEGMENT_TAU,
               simultaneous: bool = False, draws: int = 10000, seed: int = 42) -> DataFrame:
    """Fit, standard error, 95 % band and band label at every point of every series.

    Series that cannot carry the basis keep their rows with a ``status`` and no fit.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases: dict[bytes, SplineBasis] = {}
        normals: dict[int, np.ndarray] = {}
        for batch in _pieces(batches):
            parts = []
            for x, rows in _same_lengths(batch):
                raw = np.column_stack([np.asarray(batch["delta"].iloc[i], float) for i in rows])
                y = np.column_stack([np.asarray(batch["yf"].iloc[i], float) for i in rows])
                k = basis_size(len(x), k_spline)
                empty = np.full(y.shape, np.nan)
                fitted = se = low = high = empty
                edf = lam = np.full(len(rows), np.nan)
                status = "ok"
                try:
                    if x.tobytes() not in bases:
                        if len(bases) >= 64:
                            bases.clear()
                        bases[x.tobytes()] = SplineBasis(x, k)
                    basis = bases[x.tobytes()]
                    fitted, se, edf, lam, kept = basis.fit(y)
                    crit = np.full(len(rows), Z95)
                    if simultaneous:
                        waves = kept.shape[1]
                        if waves not in normals:
                            rng = np.random.default_rng(seed)
                            normals.clear()
                            normals[waves] = np.vstack([rng.standard_normal((2, draws)), rng.standard_normal((waves, draws))])
                        crit = np.array([basis.simultaneous(w, normals[waves]) for w in kept])
                        crit[~np.isfinite(crit)] = Z95
                    low, high = fitted - crit * se, fitted + crit * se
                except (ValueError, np.linalg.LinAlgError) as problem:
                    status = f"no fit: {problem}"
                times = len(rows)
                parts.append(pd.DataFrame({
                    "dataset": np.repeat(batch["dataset"].to_numpy()[rows], len(x)), "x": np.tile(x, times),
                    "copy": np.tile(_copies(x), times), "delta": raw.T.ravel(), "yf": y.T.ravel(),
                    "fit": fitted.T.ravel(), "se": se.T.ravel(), "lower": low.T.ravel(), "upper": high.T.ravel(),
                    "k_spline": k, "edf": np.repeat(edf, len(x)), "log_lambda": np.repeat(lam, len(x)),
                    "status": status}))
            if parts:
                yield pd.concat(parts)

    packed = _series_arrays(smooth(series, smooth_k, max_length), "yf", "delta")
    fits = packed.mapInPandas(fit, FIT_SCHEMA)
    numbers = ("fit", "se", "lower", "upper", "edf", "log_lambda")
    clean = fits.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers})
    return clean.withColumn("label_fit", band_label(F.col("lower"), F.col("upper"), tau))


def mean_changes(y: np.ndarray) -> np.ndarray:
    """Optimal segment number of every point, for each column of y.

    Minimises the sum over segments of the squared deviations plus log(segment length), plus
    3 log(n) per change (the modified BIC), by a dynamic programme that drops starts which can't be
    the best again, so that series with many changes take time in proportion to their length. A
    start stays while a column of its block has use for it; the longer the series, the smaller the block.
    """
    n, many = y.shape
    at_once = max(1, (1 << 16) // max(n, 1))
    if many > at_once:
        return np.hstack([mean_changes(y[:, c:c + at_once]) for c in range(0, many, at_once)])
    penalty = 3 * np.log(n)
    total = np.vstack([np.zeros(many), np.cumsum(y, 0)])
    square = np.vstack([np.zeros(many), np.cumsum(y * y, 0)])
    best = np.full((n + 1, many), np.inf)
    best[0] = -penalty
    last = np.zeros((n + 1, many), dtype=int)
    starts = np.zeros(1, dtype=int)
    for t in range(1, n + 1):
        size = (t - starts)[:, None]
        gain = total[t] - total[starts]
        options = best[starts] + square[t] - square[starts] - gain * gain / size + np.log(size) + penalty
        pick = options.argmin(0)
        last[t] = starts[pick]
        best[t] = options[pick, np.arange(many)]
        if t < n:
            # Cutting a segment at t never raises its squares, and its logarithms by no more than this.
            saved = np.log(1 / size + 1 / (n - t))
            useless = options - penalty + saved > best[t] + 1e-9 * (1 + np.abs(best[t]))
            starts = np.append(starts[~useless.all(1)], t)
    segment = np.zeros((n, many), dtype=int)
    for c in range(many):
        end, cuts = n, []
        while end > 0:
            cuts.append(last[end, c])
            end = last[end, c]
        for number, start in enumerate(reversed(cuts)):
            segment[start:, c] = number
    return segment


def changepoint_labels(series: DataFrame, tau: float = SEGMENT_TAU, smooth_k: int = SMOOTH_K,
                       max_length: float = MAX_LENGTH, standardize: bool = False) -> DataFrame:
    """Label every point by the mean of its change-point segment (of the 3-point smooth).

    The cost assumes unit variance. On small deltas it finds almost no change; ``standardize``
    searches on values divided by the series' deviation instead. Series of fewer than 3 points have
    no smooth: they are one neutral segment without a mean.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            parts = []
            sizes: dict[int, list[int]] = {}
            for i, x in enumerate(batch["x"]):
                sizes.setdefault(len(x), []).append(i)
            for rows in sizes.values():
                y = np.column_stack([np.asarray(batch["y3"].iloc[i], float) for i in rows])
                searched = y
                if standardize:
                    sd = y.std(0, ddof=1) if len(y) > 1 else np.ones(y.shape[1])
                    searched = y / np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
                segment = mean_changes(searched)
                for c, i in enumerate(rows):
                    size = np.bincount(segment[:, c])
                    mean = np.bincount(segment[:, c], weights=y[:, c]) / size
                    x = np.asarray(batch["x"].iloc[i], float)
                    parts.append(pd.DataFrame({
                        "dataset": batch["dataset"].iloc[i], "x": x, "copy": _copies(x),
                        "yf": np.asarray(batch["yf"].iloc[i], float), "y3": y[:, c],
                        "cp_segment": segment[:, c] + 1, "cp_mean": mean[segment[:, c]]}))
            if parts:
                yield pd.concat(parts)

    smoothed = rolling_mean(smooth(series, smooth_k, max_length), "yf", "y3", 3, "extend")
    rows = _series_arrays(smoothed, "yf", "y3").mapInPandas(
        label, "dataset string, x double, copy int, yf double, y3 double, cp_segment int, cp_mean double")
    clean = rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("y3", "cp_mean")})
    return clean.withColumn("label_cp", tau_label(F.col("cp_mean"), tau))


def consensus(fits: DataFrame, changes: DataFrame) -> DataFrame:
    """Both labels of every point and their agreement. Points of one length pair by their order."""
    both = fits.join(changes.select("dataset", "x", "copy", "cp_segment", "cp_mean", "label_cp"),
                     ["dataset", "x", "copy"]).drop("copy")
    return both.withColumn("label", agreed_label(F.col("label_fit"), F.col("label_cp")))
