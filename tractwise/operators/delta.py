"""Replicate alignment, group means, delta and its error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractwise.operators.histograms import guarded, normalise
from tractwise.operators.reads import SAMPLE
from tractwise.params import BIN_SIZE, DAY0, FULL_VIEW, TREATED


def _per_length(norm: DataFrame) -> DataFrame:
    """One value per (sample, length); shares the partitioning of the normalising window."""
    return norm.groupBy(*SAMPLE, F.col("repeat_length").alias("x")).agg(F.avg("y").alias("y"))


def _sample_counts(norm: DataFrame) -> DataFrame:
    """Valid samples per dataset and group, counted rather than joined one by one."""
    samples = norm.groupBy(*SAMPLE).agg(F.count("*").alias("_rows"))
    return samples.groupBy("dataset").agg(
        F.count_if(F.col("grp") == DAY0).alias("n_day0"),
        F.count_if(F.col("grp") == TREATED).alias("n_treated"))


def align_replicates(norm: DataFrame) -> DataFrame:
    """Lengths present in every valid sample of a group."""
    values = _per_length(norm)
    samples = norm.groupBy(*SAMPLE).agg(F.count("*").alias("_rows"))
    needed = samples.groupBy("dataset", "grp").agg(F.count("*").alias("n_samples"))
    present = values.groupBy("dataset", "grp", "x").agg(
        F.count("*").alias("_present"), F.avg("y").alias("group_avg"))
    return (
        present.join(needed, ["dataset", "grp"])
        .filter(F.col("_present") == F.col("n_samples"))
        .select("dataset", "grp", "x", "n_samples", "group_avg")
    )


def aligned_groups(norm: DataFrame) -> DataFrame:
    """Mean and spread of both groups at the lengths every valid sample of both groups has."""
    values = _per_length(norm)
    aggs = []
    for grp, tag in ((DAY0, "day0"), (TREATED, "treated")):
        y = F.when(F.col("grp") == grp, F.col("y"))
        aggs += [
            F.count(y).alias(f"_has_{tag}"), F.avg(y).alias(f"{tag}_avg"),
            F.stddev_pop(y).alias(f"{tag}_sd_pop"), F.stddev_samp(y).alias(f"{tag}_sd"),
        ]
    stats = values.groupBy("dataset", "x").agg(*aggs)
    return (
        stats.join(_sample_counts(norm), "dataset")
        .filter((F.col("_has_day0") == F.col("n_day0")) & (F.col("n_day0") > 0)
                & (F.col("_has_treated") == F.col("n_treated")) & (F.col("n_treated") > 0))
        .drop("_has_day0", "_has_treated")
        .withColumn("delta", F.col("treated_avg") - F.col("day0_avg"))
    )


def delta_table(hist: DataFrame, method: str = "minmax", strict: bool = False) -> DataFrame:
    """Group means and their difference per length; ``strict`` makes the plan fail on input without a valid file."""
    norm = normalise(hist, method)
    rows = aligned_groups(norm).select("dataset", "x", "day0_avg", "treated_avg", "delta")
    return guarded(rows, norm) if strict else rows


def replicate_error(groups: DataFrame, mode: str = "sd", compat: bool = True) -> DataFrame:
    """Add ``err``: both groups' spread, combined in quadrature.

    With ``compat`` the group mean counts as one more replicate: the deviation becomes the
    population one and the standard error divides by n + 1.
    """
    suffix, extra = ("_sd_pop", 1) if compat else ("_sd", 0)
    parts = []
    for tag in ("day0", "treated"):
        spread = F.col(f"{tag}{suffix}")
        if mode == "sem":
            spread = spread / F.sqrt(F.col(f"n_{tag}") + extra)
        elif mode != "sd":
            raise ValueError(f"unknown mode: {mode}")
        parts.append(spread * spread)
    return groups.withColumn("err", F.sqrt(parts[0] + parts[1]))


def thin(series: DataFrame, bin_size: int = BIN_SIZE, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Every bin_size-th point of a series in order of length, from the first on."""
    order = Window.partitionBy(*keys).orderBy("x")
    return series.withColumn("_i", F.row_number().over(order) - 1).filter(
        F.col("_i") % bin_size == 0).drop("_i")


def between_sets(series: DataFrame, pair: str = "pair", set_col: str = "set_id",
                 bin_size: int = BIN_SIZE) -> DataFrame:
    """SD and SEM of the two sets' deltas at the lengths both thinned sets share."""
    thinned = thin(series, bin_size, [pair, set_col])
    delta = [F.max(F.when(F.col(set_col) == i, F.col("delta"))) for i in (1, 2)]
    both = thinned.groupBy(pair, "x").agg(delta[0].alias("delta_1"), delta[1].alias("delta_2"))
    gap = F.abs(F.col("delta_1") - F.col("delta_2"))
    return both.filter(F.col("delta_1").isNotNull() & F.col("delta_2").isNotNull()).select(
        pair, "x", "delta_1", "delta_2", (gap / F.sqrt(F.lit(2.0))).alias("sd"),
        (gap / 2).alias("sem"))


def delta_plot(groups: DataFrame, error_mode: str | None = None, bin_size: int = BIN_SIZE,
               view: tuple[float, float] = FULL_VIEW, pair: str = "pair",
               set_col: str = "set_id") -> DataFrame:
    """Points of the delta plot. Between-set error where a second set exists, else replicate error.

    ``groups`` is :func:`aligned_groups` output with the pair and the set number added.
    """
    points = groups if error_mode is None else replicate_error(groups, error_mode)
    thinned = thin(points, bin_size, [pair, set_col])
    if error_mode is None:
        out = thinned.withColumn("err", F.lit(None).cast("double"))
    else:
        sets = Window.partitionBy(pair)
        marked = thinned.withColumn("_two", F.max(set_col).over(sets) > F.min(set_col).over(sets))
        shared = between_sets(groups, pair, set_col, bin_size).select(
            pair, "x", F.col(error_mode).alias("_between"))
        out = marked.join(shared, [pair, "x"], "left").withColumn(
            "err", F.when(F.col("_two"), F.col("_between")).when(F.col(set_col) == 1, F.col("err")))
    return out.filter(F.col("x").between(*view)).select(pair, set_col, "x", "delta", "err")


def overlay(groups: DataFrame, view: tuple[float, float] = FULL_VIEW) -> DataFrame:
    return groups.filter(F.col("x").between(*view)).select(
        "dataset", "x", "day0_avg", "treated_avg")


def wide_delta(hist: DataFrame, samples: Sequence[str], method: str = "minmax") -> DataFrame:
    """One column per sample, the two averages and delta last, at the aligned lengths.

    ``samples`` names the columns (``<grp>_<sample>``), so the pivot needs no extra job. A sample
    that it leaves out fails the query, as the averages would hold what no column shows.
    """
    norm = normalise(hist, method)
    name = F.concat_ws("_", "grp", "sample")
    columns = _per_length(norm).withColumn("_col", F.when(name.isin(list(samples)), name).otherwise(
        F.raise_error(F.concat(F.lit("sample without a column: "), name))))
    pivoted = columns.groupBy("dataset", "x").pivot("_col", list(samples)).agg(F.first("y"))
    groups = aligned_groups(norm).select("dataset", "x", "day0_avg", "treated_avg", "delta")
    return pivoted.join(groups, ["dataset", "x"]).select(
        "dataset", F.col("x").alias("repeat length"), *samples,
        F.col("day0_avg").alias("Day0_avg"), "treated_avg", "delta")
