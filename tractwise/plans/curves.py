"""Smoothing, change points, consensus segments and their metrics for a table of delta series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.operators.series import (segment_areas, segment_counts, segment_curves,
                                        segment_summary, segments, trim, truth_segments)
from tractwise.operators.smoothers import changepoint_labels, consensus, spline_fit
from tractwise.params import (IOU_THR, K_SPLINE, MAX_LENGTH, MIN_LEN, SEGMENT_TAU, SMOOTH_K)
from tractwise.session import settle


@dataclass
class CurveBatch:
    points: DataFrame
    segments: DataFrame
    curves: DataFrame
    metrics: DataFrame
    panel: DataFrame

    def outputs(self) -> dict[str, DataFrame]:
        """The tables that a batch saves, by file name."""
        return {"metrics.csv": self.metrics, "segments.csv": self.segments}


def curve_batch(series: DataFrame, tau: float = SEGMENT_TAU, min_len: int = MIN_LEN,
                k_spline: int = K_SPLINE, smooth_k: int = SMOOTH_K, iou_thr: float = IOU_THR,
                max_length: float = MAX_LENGTH, standardize: bool = False,
                simultaneous: bool = False) -> CurveBatch:
    """All tables of the batch; the fitted points are computed once and kept.

    Datasets with fewer than three points up to ``max_length`` only appear in the metrics.
    """
    series = settle(series.select("dataset", "x", "delta"))
    trimmed = trim(series, max_length)
    sizes = series.groupBy("dataset").agg(F.count_if(F.col("x") <= max_length).alias("n_points"))
    usable = trimmed.join(sizes.filter("n_points >= 3"), "dataset", "left_semi")
    fits = spline_fit(usable, k_spline, smooth_k, max_length, tau, simultaneous)
    changes = changepoint_labels(usable, tau, smooth_k, max_length, standardize)
    points = settle(consensus(fits, changes))

    agreed = settle(segments(points, "label", "fit", min_len))
    truth = settle(truth_segments(usable, tau, min_len, smooth_k))
    found = agreed.withColumn("source", F.lit("consensus")).unionByName(
        segments(points, "label_fit", "fit", min_len).withColumn("source", F.lit("GAM"))).unionByName(
        segments(points, "label_cp", "yf", min_len).withColumn("source", F.lit("PELT")))
    none = sizes.join(agreed, "dataset", "left_anti").select(
        "dataset", F.lit("none").alias("label"), F.lit("consensus").alias("source"))
    all_segments = found.unionByName(none, allowMissingColumns=True)

    usable_sets = sizes.filter("n_points >= 3").select("dataset")
    curves = segment_curves(agreed, truth, usable_sets, iou_thr)
    counts = segment_counts(agreed, truth, usable_sets)
    areas = segment_areas(curves, counts)

    def side(label: str, tag: str) -> list[F.Column]:
        at = F.col("label") == label
        return [F.max(F.when(at, F.col(c))).alias(f"{name}_{tag}")
                for c, name in (("n_truth", "n_truth"), ("n_pred", "n_pred"),
                                ("auc_pr", "aupr"), ("auc_roc", "auroc"))]

    per_file = areas.groupBy("dataset").agg(*side("expansion", "exp"), *side("contraction", "con"))
    status = points.groupBy("dataset").agg(F.max("k_spline").alias("k_spline"),
                                           F.max("status").alias("status"))
    known = per_file.join(segment_summary(agreed, usable_sets), "dataset").join(status, "dataset")
    enough = F.col("n_points") >= 3
    short = F.lit(f"no data ≤ {max_length:g}")
    metrics = sizes.join(known, "dataset", "left").select(
        F.col("dataset").alias("file"), F.when(enough, F.col("n_points")).otherwise(0).alias("n_points"),
        F.lit(float(tau)).alias("tau"), F.lit(min_len).alias("min_len"), "k_spline",
        F.lit(float(iou_thr)).alias("iou_thr"),
        F.when(enough, F.lit(float(max_length))).alias("max_length"),
        *[F.coalesce(c, F.lit(0)).alias(c)
          for c in ("n_truth_exp", "n_pred_exp", "n_truth_con", "n_pred_con")],
        "aupr_exp", "auroc_exp", "aupr_con", "auroc_con",
        F.when(enough, F.col("summary")).otherwise(short).alias("summary"),
        F.when(enough, F.col("status")).otherwise("too few points").alias("status"))
    return CurveBatch(points, all_segments, curves, metrics, signal_panel(points, agreed))


def signal_panel(points: DataFrame, agreed: DataFrame) -> DataFrame:
    """Data behind the signal figure, each point with the consensus band it lies in."""
    bands = agreed.select(F.col("dataset").alias("_d"), F.col("label").alias("band"), "start_rl", "end_rl")
    inside = ((F.col("dataset") == F.col("_d")) & (F.col("x") >= F.col("start_rl"))
              & (F.col("x") <= F.col("end_rl")))
    return points.join(bands, inside, "left").select(
        "dataset", "x", "delta", "yf", "fit", "lower", "upper", F.col("label_fit").alias("label"), "band")
