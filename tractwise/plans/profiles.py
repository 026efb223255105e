"""Binned clustering: train on some files, predict and evaluate the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tractwise.functions.columns import proxy_label
from tractwise.operators.clusters import (ClusterModel, center_frame, file_vectors, predicted_bins,
                                          train_assignments, train_model)
from tractwise.operators.evaluate import auc, roc_points
from tractwise.operators.series import rolling_mean
from tractwise.params import CONTRACTION, EXPANSION, SMOOTH_K
from tractwise.session import settle


@dataclass
class ProfileBatch:
    model: ClusterModel
    assignments: DataFrame
    centers: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    sides: DataFrame
    panel: DataFrame

    def outputs(self) -> dict[str, DataFrame]:
        """The tables that a batch saves, by file name."""
        return {"train_assignments.csv": flat(self.assignments), "cluster_centers.csv": flat(self.centers),
                "test_metrics.csv": self.metrics, "test_bin_predictions.csv": flat(self.predictions)}

    def overall(self) -> DataFrame:
        """Pooled areas over all test bins, one row per side."""
        return self._pooled(auc)

    def overall_curve(self) -> DataFrame:
        """Pooled ROC points of both sides."""
        return self._pooled(roc_points)

    def curves(self) -> DataFrame:
        """ROC points of both sides of every test file that has both classes."""
        return self._both(roc_points, ["file"])

    def _pooled(self, make: Callable[..., DataFrame]) -> DataFrame:
        return self._both(make, [])

    def _both(self, make: Callable[..., DataFrame], keys: list[str]) -> DataFrame:
        exp = make(self.sides, keys, "y_exp", "y_pred").withColumn("side", F.lit(EXPANSION))
        con = make(self.sides, keys, "y_con", "minus").withColumn("side", F.lit(CONTRACTION))
        return exp.unionByName(con)


def profile_batch(train: DataFrame, test: DataFrame, method: str = "gmm", **options) -> ProfileBatch:
    """All tables of the batch. Both inputs are long: file, x, delta."""
    spark = train.sparkSession
    train = settle(train.select("file", "x", "delta"))
    model = train_model(train, method, **options)
    test = settle(test.select("file", "x", "delta"))
    scored = settle(file_vectors(test, model))
    predictions = settle(predicted_bins(scored, model))
    observed = F.col("y_bin")
    sides = predictions.withColumn("y_exp", proxy_label(observed, model.tau, EXPANSION)).withColumn(
        "y_con", proxy_label(observed, model.tau, CONTRACTION)).withColumn("minus", -F.col("y_pred"))
    areas = [auc(sides, ["file"], label, score).select("file", F.col("auc").alias(name))
             for label, score, name in (("y_exp", "y_pred", "auc_exp"), ("y_con", "minus", "auc_con"))]
    assigned = predictions.select(
        "file", F.col("cluster").alias("assigned_cluster"), "cluster_type").distinct()
    metrics = assigned.join(areas[0], "file").join(areas[1], "file").select(
        "file", F.lit(method).alias("method"), F.lit(model.k).alias("K"),
        F.lit(float(model.tau)).alias("tau"), "assigned_cluster", "cluster_type", "auc_exp", "auc_con")
    return ProfileBatch(model, train_assignments(train, model), center_frame(spark, model),
                        predictions, metrics, sides, cluster_panel(test, scored, model))


def cluster_panel(test: DataFrame, scored: DataFrame, model: ClusterModel,
                  smooth_k: int = SMOOTH_K) -> DataFrame:
    """Data behind the figure of every test file, one row per mark.

    ``layer`` is signal (smoothed delta at x), bin mean (at the middle of a bin) or predicted (a step
    from x to x_end, which ends at the middles of the outermost bins). ``caption`` names the cluster
    and its posteriors.
    """
    share = F.transform(F.arrays_zip(F.sequence(F.lit(1), F.size("probs")).alias("i"), "probs"),
                        lambda c: F.format_string("C%d=%.1f%%", c["i"], c["probs"] * 100))
    caption = F.concat(F.format_string("Cluster %d (%s); posteriors: ", "cluster", "cluster_type"),
                       F.array_join(share, ", "))
    named = scored.select("file", caption.alias("caption"))
    line = rolling_mean(test.withColumnRenamed("file", "dataset"), "delta", "value", smooth_k)
    empty = F.lit(None).cast("double")
    signal = line.select(F.col("dataset").alias("file"), F.lit("signal").alias("layer"), "x",
                         empty.alias("x_end"), "value")
    first, half = model.grid.mids[0], model.grid.width / 2
    cells = predicted_bins(scored, model)
    marks = F.array(
        F.struct(F.lit("bin mean").alias("layer"), F.col("mid").alias("x"), empty.alias("x_end"),
                 F.col("y_bin").alias("value")),
        F.struct(F.lit("predicted").alias("layer"), F.greatest(F.col("mid") - half, F.lit(first)).alias("x"),
                 F.least(F.col("mid") + half, F.lit(model.grid.mids[-1])).alias("x_end"),
                 F.col("y_pred").alias("value")))
    return signal.unionByName(cells.select("file", F.inline(marks))).join(named, "file")


def flat(table: DataFrame) -> DataFrame:
    """Lists as text, which a CSV file can hold."""
    lists = [f.name for f in table.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return table.withColumns({c: F.to_json(c) for c in lists})
