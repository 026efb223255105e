"""Binned feature vectors: one array of bin means per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.params import BIN_WIDTH


@dataclass(frozen=True)
class BinGrid:
    """Right-open bins of equal width; the last one is closed."""

    start: float
    width: float
    count: int

    @property
    def breaks(self) -> list[float]:
        return [self.start + i * self.width for i in range(self.count + 1)]

    @property
    def mids(self) -> list[float]:
        return [self.start + (i + 0.5) * self.width for i in range(self.count)]

    def index(self, x: Column) -> Column:
        """1-based bin of a length, NULL outside of the grid."""
        last = self.start + self.count * self.width
        raw = F.floor((x - self.start) / self.width) + 1
        inside = (x >= self.start) & (x <= last)
        return F.when(inside, F.least(raw, F.lit(self.count))).cast("int")

    def frame(self, spark) -> DataFrame:
        half = F.lit(self.width) / 2
        low = F.lit(self.start) + (F.col("bin") - 1) * self.width
        return spark.range(1, self.count + 1).select(F.col("id").cast("int").alias("bin")).select(
            "bin", low.alias("low"), (low + self.width).alias("high"), (low + half).alias("mid"))


def fit_grid(train: DataFrame, width: float = BIN_WIDTH) -> BinGrid:
    """Whole-number range of the training lengths, one width beyond its upper end."""
    ends = train.agg(F.floor(F.min("x")).alias("lo"), F.ceil(F.max("x")).alias("hi")).first()
    if ends["lo"] is None or ends["hi"] <= ends["lo"]:
        raise ValueError("invalid length range in the training data")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    count = int((hi + width - lo) / width + 1e-10)
    if count < 2:
        raise ValueError("fewer than two bins; use a smaller width")
    return BinGrid(lo, float(width), count)


def assign_bins(points: DataFrame, grid: BinGrid) -> DataFrame:
    return points.withColumn("bin", grid.index(F.col("x"))).filter(F.col("bin").isNotNull())


def bin_means(points: DataFrame, grid: BinGrid, key: str = "file") -> DataFrame:
    """Mean delta per file and bin, as one array per file; empty bins are 0.

    The means are partially aggregated; an array never exceeds the number of bins.
    """
    means = points.groupBy(key, grid.index(F.col("x")).alias("bin")).agg(
        F.avg("delta").alias("value"))
    cell = F.when(F.col("bin").isNotNull(), F.struct("bin", "value"))
    every = F.sequence(F.lit(1), F.lit(grid.count))
    return means.groupBy(key).agg(F.map_from_entries(F.collect_list(cell)).alias("_m")).select(
        key, F.transform(every, lambda b: F.coalesce(
            F.try_element_at("_m", b), F.lit(0.0))).alias("vec"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Per bin: mean and sample deviation over the files; a zero deviation becomes 1."""
    sd = F.stddev_samp("value")
    return vectors.select(F.posexplode("vec").alias("_i", "value")).groupBy(
        (F.col("_i") + 1).alias("bin")).agg(
        F.avg("value").alias("mean"),
        F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd).alias("sd"))


def _stat_arrays(stats: DataFrame) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("bin", "mean", "sd")))
    return stats.agg(ordered).scalar()


def scale_vectors(vectors: DataFrame, stats: DataFrame, out: str = "z") -> DataFrame:
    """z-score arrays with training statistics; non-finite cells become 0. No shuffle."""
    def cell(v: Column, s: Column) -> Column:
        z = (v - s["mean"]) / s["sd"]
        return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z)

    return vectors.withColumn("_stats", _stat_arrays(stats)).withColumn(
        out, F.zip_with("vec", "_stats", cell)).drop("_stats")
