"""Smoothing, runs and segments of delta series, and segment-level precision/recall.

Input: dataset, x, delta. A series is trimmed to ``max_length`` repeat units, so a window over
one dataset stays small; datasets spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tractwise.functions.columns import length_text, overlap_share, tau_label
from tractwise.params import (CONTRACTION, EXPANSION, IOU_THR, MAX_LENGTH, MIN_LEN, NEUTRAL,
                              SEGMENT_TAU, SMOOTH_K)

SIDES = (EXPANSION, CONTRACTION)


def by_length() -> WindowSpec:
    return Window.partitionBy("dataset").orderBy("x")


def trim(series: DataFrame, max_length: float = MAX_LENGTH) -> DataFrame:
    return series.filter(F.col("x") <= max_length)


def rolling_mean(series: DataFrame, value: str, out: str, k: int = SMOOTH_K,
                 edges: str = "raw") -> DataFrame:
    """Centred mean of k neighbours; incomplete windows keep the raw value or the nearest mean."""
    frame = by_length().rowsBetween(-((k - 1) // 2), k // 2)
    mean = F.when(F.count(value).over(frame) == k, F.avg(value).over(frame))
    if edges == "raw":
        return series.withColumn(out, F.coalesce(mean, F.col(value)))
    if edges != "extend":
        raise ValueError(f"unknown edges: {edges}")
    last = F.last("_mean", ignorenulls=True).over(
        by_length().rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("_mean", ignorenulls=True).over(
        by_length().rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn("_mean", mean).withColumn(
        out, F.coalesce(last, following)).drop("_mean")


def smooth(series: DataFrame, k: int = SMOOTH_K, max_length: float = MAX_LENGTH) -> DataFrame:
    return rolling_mean(trim(series, max_length), "delta", "yf", k)


def segments(series: DataFrame, label: str, value: str, min_len: int = MIN_LEN) -> DataFrame:
    """Runs of one non-neutral label over neighbouring rows, at least min_len long."""
    change = F.col(label) != F.lag(label).over(by_length())
    marked = series.withColumn("_new", F.when(change, 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(
        by_length().rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("dataset", "_run")
        .agg(F.first(label).alias("label"), F.min("x").alias("start_rl"),
             F.max("x").alias("end_rl"), F.count("*").alias("len"),
             F.avg(value).alias("mean_eff"), F.max(F.abs(value)).alias("max_abs"))
        .filter((F.col("label") != NEUTRAL) & (F.col("len") >= min_len))
        .drop("_run")
    )


def truth_segments(series: DataFrame, tau: float = SEGMENT_TAU, min_len: int = MIN_LEN,
                   k: int = SMOOTH_K) -> DataFrame:
    labelled = smooth(series, k).withColumn("truth", tau_label(F.col("yf"), tau))
    return segments(labelled, "truth", "yf", min_len)


def segment_summary(segs: DataFrame, datasets: DataFrame) -> DataFrame:
    """One line of text per dataset, also for those without a segment."""
    ranges = segs.groupBy("dataset", "label").agg(
        F.concat(F.col("label"), F.lit(" between lengths "), length_text(F.min("start_rl")),
                 F.lit("–"), length_text(F.max("end_rl"))).alias("txt"))
    lines = ranges.groupBy("dataset").agg(
        F.array_join(F.sort_array(F.collect_list("txt")), ", ").alias("summary"))
    return datasets.join(lines, "dataset", "left").select(
        "dataset", F.coalesce("summary", F.lit("no robust change segments")).alias("summary"))


def _overlaps(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted and true segments of one label that touch; all others share nothing.

    Segments of one series are disjoint, so the touching pairs grow linearly, not as a product.
    """
    p = pred.select("dataset", "label", F.col("start_rl").alias("p_start"),
                    F.col("end_rl").alias("p_end"), F.abs("mean_eff").alias("score"))
    t = truth.select(F.col("dataset").alias("t_dataset"), F.col("label").alias("t_label"),
                     F.col("start_rl").alias("t_start"), F.col("end_rl").alias("t_end"))
    touching = ((p.dataset == t.t_dataset) & (p.label == t.t_label)
                & (F.col("t_start") <= F.col("p_end")) & (F.col("p_start") <= F.col("t_end")))
    share = overlap_share(F.col("p_start"), F.col("p_end"), F.col("t_start"), F.col("t_end"))
    return p.join(t, touching, "left").withColumn(
        "iou", F.when(F.col("t_start").isNull(), 0.0).otherwise(share))


def segment_iou(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Every predicted segment with its best overlap."""
    return _overlaps(pred, truth).groupBy(
        "dataset", "label", F.col("p_start").alias("start_rl"), F.col("p_end").alias("end_rl"),
        "score").agg(F.max("iou").alias("best_iou"))


def segment_counts(pred: DataFrame, truth: DataFrame, datasets: DataFrame) -> DataFrame:
    """Predicted and true segments of every dataset and side, zero included."""
    grid = datasets.select("dataset", F.explode(F.array(*map(F.lit, SIDES))).alias("label"))
    n_pred = pred.groupBy("dataset", "label").agg(F.count("*").alias("n_pred"))
    n_truth = truth.groupBy("dataset", "label").agg(F.count("*").alias("n_truth"))
    keys = ["dataset", "label"]
    return grid.join(n_pred, keys, "left").join(n_truth, keys, "left").na.fill(0, ["n_pred", "n_truth"])


def segment_curves(pred: DataFrame, truth: DataFrame, datasets: DataFrame,
                   iou_thr: float = IOU_THR) -> DataFrame:
    """Counts and rates at every score threshold, the highest first (``step`` 1, 2, ...).

    A true segment counts as found from the highest score among the predictions that overlap it
    enough, so one running sum in order of the score replaces the loop over thresholds. Sides
    without a prediction or without a truth get the two fixed end points.
    """
    if iou_thr <= 0:
        raise ValueError("iou_thr must be positive")
    pairs = _overlaps(pred, truth)
    best = pairs.groupBy("dataset", "label", "p_start", "score").agg(F.max("iou").alias("best_iou"))
    hit = F.col("best_iou") >= iou_thr
    verdicts = best.select("dataset", "label", "score", hit.cast("int").alias("tp"),
                           (~hit).cast("int").alias("fp"), F.lit(0).alias("found"))
    found = (
        pairs.filter(F.col("iou") >= iou_thr)
        .groupBy("dataset", "label", "t_start").agg(F.max("score").alias("score"))
        .select("dataset", "label", "score", F.lit(0).alias("tp"), F.lit(0).alias("fp"),
                F.lit(1).alias("found"))
    )
    # dealt out anew: a union may claim its parts' partitioning, which later keyed steps would trust
    at_score = verdicts.unionByName(found).repartition("dataset", "label").groupBy("dataset", "label", "score").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("found").alias("found"))
    down = Window.partitionBy("dataset", "label").orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    counts = segment_counts(pred, truth, datasets)
    scored = (
        at_score.join(counts, ["dataset", "label"]).filter("n_pred > 0 AND n_truth > 0")
        .select("dataset", "label", F.row_number().over(down).alias("step"),
                F.col("score").alias("threshold"), F.sum("tp").over(upto).alias("tp"),
                F.sum("fp").over(upto).alias("fp"),
                (F.col("n_truth") - F.sum("found").over(upto)).alias("fn"), "n_truth")
    )

    def ratio(top: str, bottom: F.Column) -> F.Column:
        return F.col(top) / F.greatest(bottom.cast("double"), F.lit(1e-9))

    measured = scored.select(
        "dataset", "label", "step", "threshold", "tp", "fp", "fn",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        ratio("fp", F.col("fp") + F.col("n_truth") - F.col("tp")).alias("fpr"))
    end = F.when(F.col("step") == 1, 0.0).otherwise(1.0)
    fixed = (
        counts.filter("n_pred = 0 OR n_truth = 0")
        .withColumn("step", F.explode(F.array(F.lit(1), F.lit(2))))
        .select("dataset", "label", "step", end.alias("recall"), end.alias("fpr"),
                F.when(F.col("step") == 1, 1.0).otherwise(
                    F.col("n_truth") / (F.col("n_truth") + 1e-9)).alias("precision"))
    )
    both = measured.unionByName(fixed, allowMissingColumns=True).repartition("dataset", "label")
    return both.withColumn("tpr", F.col("recall"))


def segment_areas(curves: DataFrame, counts: DataFrame) -> DataFrame:
    """Trapezoid areas under the segment curves; NULL without at least two thresholds."""
    real = curves.filter(F.col("threshold").isNotNull())
    sides = Window.partitionBy("dataset", "label")

    def area(x: str, y: str) -> F.Column:
        order = sides.orderBy(x, "step")
        return (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2

    areas = (
        real.withColumn("_roc", area("fpr", "tpr")).withColumn("_pr", area("recall", "precision"))
        .groupBy("dataset", "label").agg(F.sum("_roc").alias("auc_roc"), F.sum("_pr").alias("auc_pr"))
    )
    return counts.join(areas, ["dataset", "label"], "left").select(
        "dataset", "label", "n_pred", "n_truth", "auc_roc", "auc_pr")
