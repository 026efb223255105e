"""Per-dataset features of delta series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tractwise.functions.columns import is_finite, tau_label
from tractwise.params import FIRST_N, MIN_ROWS, NEUTRAL_TAU, STRONG_TAU, ZERO_EPS


def per_dataset() -> WindowSpec:
    return Window.partitionBy("dataset")


def usable_deltas(series: DataFrame, first_n: int = FIRST_N, min_rows: int = MIN_ROWS,
                  drop_zeros: bool = True, zero_eps: float = ZERO_EPS) -> DataFrame:
    """The first finite, non-zero deltas of each dataset in file order (``pos``).

    The row limit is applied before the shuffle as well, so a hot dataset sends few rows.
    """
    kept = series.filter(is_finite(F.col("delta")))
    if drop_zeros:
        kept = kept.filter(F.abs("delta") > zero_eps)
    head = kept.withColumn("rank", F.row_number().over(per_dataset().orderBy("pos"))).filter(
        F.col("rank") <= first_n)
    return head.withColumn("n", F.count("*").over(per_dataset())).filter(F.col("n") >= min_rows).select(
        "dataset", "pos", "rank", "n", "delta")


def skipped_datasets(series: DataFrame, used: DataFrame) -> DataFrame:
    gone = series.select("dataset").distinct().join(
        used.select("dataset").distinct(), "dataset", "left_anti")
    return gone.withColumn("reason", F.lit("too few usable deltas"))


def robust_features(usable: DataFrame, neutral_tau: float = NEUTRAL_TAU,
                    strong_tau: float = STRONG_TAU) -> DataFrame:
    """Moments, robust summaries and proportions; one shuffle, shared by all windows."""
    d = F.col("delta")
    ranked = usable.withColumn("_r", F.row_number().over(per_dataset().orderBy("delta"))).withColumn(
        "_med", F.median("delta").over(per_dataset()))
    cut = F.floor(F.col("n") * 0.1)
    inner = (F.col("_r") > cut) & (F.col("_r") <= F.col("n") - cut)

    def share(condition: F.Column) -> F.Column:
        return F.avg(condition.cast("double"))

    distinct = F.size(F.collect_set("delta"))
    return ranked.groupBy("dataset").agg(
        F.first("n").cast("bigint").alias("n"),
        F.avg(d).alias("mean_delta"),
        F.avg(F.when(inner, d)).alias("trimmed_mean"),
        F.first("_med").alias("median_delta"),
        F.stddev_samp(d).alias("sd_delta"),
        (F.median(F.abs(d - F.col("_med"))) * 1.4826).alias("mad_delta"),
        F.when(distinct >= 3, F.skewness(d)).otherwise(0.0).alias("skew_delta"),
        (F.percentile(d, F.lit(0.75)) - F.percentile(d, F.lit(0.25))).alias("iqr_delta"),
        F.avg(F.abs(d)).alias("mean_abs"),
        share(d > 0).alias("prop_pos"), share(d < 0).alias("prop_neg"),
        share(F.abs(d) <= neutral_tau).alias("prop_neutral"),
        share(d >= strong_tau).alias("prop_strong_pos"),
        share(d <= -strong_tau).alias("prop_strong_neg"))


def _normal_log(x, mean, var):
    return -0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var)


def two_component_fits(x: np.ndarray, ok: np.ndarray, equal: bool, tol: float = 1e-5,
                       max_iter: int = 500):
    """EM for two normal components in every row of a padded matrix at once.

    Starts from the split at the median. Returns means, weights and the log-likelihood, which is
    NaN for rows whose variance vanishes.
    """
    n = ok.sum(1)
    data = np.where(ok, x, np.nan)
    low = (data <= np.nanmedian(data, axis=1)[:, None]) & ok
    z = np.stack([low, ok & ~low]).astype(float)
    x = np.where(ok, x, 0.0)
    old = np.full(len(x), -np.inf)
    live = (z.sum(2) > 0).all(0)
    loglik = np.full(len(x), np.nan)
    mu, pi = np.full((2, len(x)), np.nan), np.full((2, len(x)), np.nan)
    rows = np.flatnonzero(live)
    z, old = z[:, rows], old[rows]
    with np.errstate(all="ignore"):
        for _ in range(max_iter):
            if not len(rows):
                break
            xr, okr, nr = x[rows], ok[rows], n[rows]
            size = z.sum(2)
            mean = (z * xr).sum(2) / size
            spread = (z * (xr - mean[:, :, None]) ** 2).sum(2)
            var = np.broadcast_to(spread.sum(0) / nr, size.shape) if equal else spread / size
            logs = np.log(size / nr)[:, :, None] + _normal_log(xr, mean[:, :, None], var[:, :, None])
            top = logs.max(0)
            total = top + np.log(np.exp(logs - top).sum(0))
            z = np.where(okr, np.exp(logs - total), 0.0)
            ll = np.where(okr, total, 0.0).sum(1)
            bad = ~np.isfinite(ll) | (var.min(0) <= np.finfo(float).eps) | (size.min(0) <= 0)
            done = np.abs(ll - old) / (1 + np.abs(ll)) < tol
            mu[:, rows], pi[:, rows] = mean, size / nr
            loglik[rows] = np.where(bad, np.nan, ll)
            keep = ~(bad | done)
            rows, z, old = rows[keep], z[:, keep], ll[keep]
    return mu, pi, loglik


def _mixture_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if batch.empty:
            continue
        lists = [np.asarray(d, dtype=float) for d in batch["deltas"]]
        n = np.array([len(d) for d in lists])
        x = np.zeros((len(lists), n.max()))
        ok = np.arange(n.max()) < n[:, None]
        x[ok] = np.concatenate(lists)
        mean = x.sum(1) / n
        sd = np.array([d.std(ddof=1) if len(d) > 1 else np.nan for d in lists])
        varied = np.array([len(np.unique(d)) >= 2 for d in lists]) & np.isfinite(sd) & (sd > 0)
        var = np.where(varied, (np.where(ok, x - mean[:, None], 0.0) ** 2).sum(1) / n, 1.0)
        single = np.where(ok, _normal_log(x, mean[:, None], var[:, None]), 0.0).sum(1)
        best = np.where(varied, 2 * single - 2 * np.log(n), np.inf)
        k = np.ones(len(lists), dtype=int)
        mu = np.stack([mean, np.full(len(lists), np.nan)])
        pi = np.stack([np.ones(len(lists)), np.full(len(lists), np.nan)])
        for equal, params in ((True, 4), (False, 5)):
            fit_mu, fit_pi, loglik = two_component_fits(x, ok, equal)
            bic = 2 * loglik - params * np.log(n)
            better = varied & np.isfinite(bic) & (bic > best)
            order = np.argsort(fit_mu, axis=0)
            mu[:, better] = np.take_along_axis(fit_mu, order, 0)[:, better]
            pi[:, better] = np.take_along_axis(fit_pi, order, 0)[:, better]
            k[better], best[better] = 2, bic[better]
        two = k == 2
        weight = np.maximum(np.where(two, pi, 1.0), 1e-12)
        yield pd.DataFrame({
            "dataset": batch["dataset"].to_numpy(), "mix_k": k.astype(float),
            "mix_mu1": mu[0], "mix_mu2": np.where(two, mu[1], np.nan),
            "mix_pi1": pi[0], "mix_pi2": np.where(two, pi[1], np.nan),
            "mix_sep": np.where(two, np.abs(mu[1] - mu[0]) / np.where(varied, sd, 1.0), 0.0),
            "mix_entropy": np.where(two, -(weight * np.log(weight)).sum(0), 0.0),
        })


def mixture_features(usable: DataFrame) -> DataFrame:
    """One or two normal components per dataset, chosen by BIC; many datasets per Arrow batch.

    A dataset's deltas fit one array because ``usable_deltas`` keeps only the first ones.
    """
    arrays = usable.groupBy("dataset").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "delta"))),
                    lambda r: r["delta"]).alias("deltas"))
    names = ["mix_k", "mix_mu1", "mix_mu2", "mix_pi1", "mix_pi2", "mix_sep", "mix_entropy"]
    schema = "dataset string, " + ", ".join(f"{name} double" for name in names)
    fits = arrays.mapInPandas(_mixture_batches, schema)
    return fits.select("dataset", *[F.nanvl(name, F.lit(None).cast("double")).alias(name)
                                    for name in names])


def dataset_features(series: DataFrame, neutral_tau: float = NEUTRAL_TAU,
                     strong_tau: float = STRONG_TAU, **usable_options) -> DataFrame:
    """All features and the coarse label by the mean delta."""
    usable = usable_deltas(series, **usable_options)
    joined = robust_features(usable, neutral_tau, strong_tau).join(
        mixture_features(usable), "dataset")
    return joined.withColumn("true_label", tau_label(F.col("mean_delta"), neutral_tau))


def equal_width_counts(df: DataFrame, value: str, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value, overall."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    raw = F.floor((F.col(value) - ends["lo"]) / width) + 1
    placed = F.when(ends["hi"] > ends["lo"], F.least(raw, F.lit(bins))).otherwise(1)
    return df.withColumn("bin", placed.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def first_datasets(usable: DataFrame, k: int = 12) -> DataFrame:
    """The first dataset names in sorted order."""
    return usable.select("dataset").distinct().orderBy("dataset").limit(k)


def small_multiples(usable: DataFrame, k: int = 12, bins: int = 40) -> DataFrame:
    """Per-dataset histograms of the used deltas for the first k names, each on its own range."""
    shown = usable.join(first_datasets(usable, k), "dataset", "left_semi")
    lo, hi = F.min("delta").over(per_dataset()), F.max("delta").over(per_dataset())
    raw = F.floor((F.col("delta") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1
    placed = F.when(F.col("_hi") > F.col("_lo"), F.least(raw, F.lit(bins))).otherwise(1)
    return (
        shown.withColumn("_lo", lo).withColumn("_hi", hi)
        .withColumn("bin", placed.cast("int")).groupBy("dataset", "bin")
        .agg(F.count("*").alias("n"))
    )
