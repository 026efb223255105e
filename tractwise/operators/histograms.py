"""Per-sample work on histograms.

Input: dataset, grp, sample, pos, repeat_length, reads. A histogram holds at most one row per
repeat length, so windows over one sample stay small however many reads were counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tractwise.functions.columns import is_finite, to_number
from tractwise.operators.reads import SAMPLE
from tractwise.params import PEAK_SHARE


def per_sample() -> WindowSpec:
    return Window.partitionBy(*SAMPLE)


def coerce_numbers(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Text columns to numbers; rows with a missing or non-numeric value are dropped."""
    out = df
    for name in text_cols:
        out = out.withColumn(name, to_number(F.col(name)))
    return out.dropna(subset=text_cols)


def add_positions(hist: DataFrame) -> DataFrame:
    """File order of a histogram that was counted rather than read: ascending length."""
    order = per_sample().orderBy("repeat_length")
    return hist.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def _with_range(hist: DataFrame) -> DataFrame:
    """Rows of the samples whose reads span a finite, non-zero range, with its two ends."""
    ends = hist.withColumn("_lo", F.min("reads").over(per_sample())).withColumn(
        "_hi", F.max("reads").over(per_sample()))
    span = F.col("_hi") - F.col("_lo")
    return ends.filter(is_finite(span) & (span != 0))


def keep_valid(hist: DataFrame) -> DataFrame:
    return _with_range(hist).drop("_lo", "_hi")


def valid_samples(hist: DataFrame) -> DataFrame:
    span = F.max("reads") - F.min("reads")
    return (
        hist.groupBy(*SAMPLE)
        .agg(F.count("*").alias("n_lengths"), span.alias("reads_range"))
        .filter(is_finite(F.col("reads_range")) & (F.col("reads_range") != 0))
    )


def require_valid(hist: DataFrame) -> DataFrame:
    """The valid rows; an error when no sample of the input can be used."""
    kept = keep_valid(hist)
    if kept.isEmpty():
        raise ValueError("no valid histogram in the input")
    return kept


def guarded(rows: DataFrame, norm: DataFrame, where: str = "the input") -> DataFrame:
    """The rows; their plan fails when ``norm`` has no sample, that is, when no file was valid."""
    message = f"No valid files found in {where} (check delimiter/format)."
    found = norm.agg(F.count("*").alias("_n")).filter(
        F.when(F.col("_n") > 0, F.lit(False)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return rows.unionByName(found.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def normalise(hist: DataFrame, method: str = "minmax") -> DataFrame:
    """Add ``y``: reads scaled to [0, 1] per sample, or to percent of the sample's reads."""
    kept = _with_range(hist)
    if method == "minmax":
        y = (F.col("reads") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    elif method == "percent":
        y = F.col("reads") / F.sum("reads").over(per_sample()) * 100
    else:
        raise ValueError(f"unknown method: {method}")
    return kept.withColumn("y", y).drop("_lo", "_hi")


def instability(hist: DataFrame, share: float = PEAK_SHARE) -> DataFrame:
    """Mode, instability, contraction and expansion index of every sample.

    The change from the main allele is a difference of row positions, not of lengths.
    """
    peak = F.max("reads").over(per_sample())
    first_peak = F.struct(F.col("reads"), -F.col("pos"))
    marked = hist.select(
        *SAMPLE, "pos", "repeat_length", "reads", peak.alias("peak"),
        F.max_by("pos", first_peak).over(per_sample()).alias("main_pos"),
        F.max_by("repeat_length", first_peak).over(per_sample()).alias("mode"),
    ).filter(F.col("reads") > share * F.col("peak"))
    change = F.col("pos") - F.col("main_pos")
    weighted = F.col("reads") * change
    total = F.sum("reads")
    return marked.groupBy(*SAMPLE).agg(
        F.first("mode").alias("mode"),
        F.first("peak").alias("highest_peak"),
        (F.sum(weighted) / total).alias("instability_index"),
        (F.coalesce(F.sum(F.when(change < 0, weighted)), F.lit(0.0)) / total)
        .alias("contraction_index"),
        (F.coalesce(F.sum(F.when(change > 0, weighted)), F.lit(0.0)) / total)
        .alias("expansion_index"),
    )


def peak_threshold(hist: DataFrame, share: float = PEAK_SHARE) -> DataFrame:
    return hist.select(
        *SAMPLE, "repeat_length", "reads",
        (share * F.max("reads").over(per_sample())).alias("threshold"))
