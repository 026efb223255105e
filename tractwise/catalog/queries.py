"""One query per operator, each over whole tables. Doubles are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise import fixtures as fx
from tractwise.functions import columns as col
from tractwise.operators import (bins, centers, clusters, delta, evaluate, features, hierarchy,
                                 histograms, reads, series, smoothers, split)
from tractwise.params import BIN_TAU, FEATURES, NEUTRAL_TAU, SEGMENT_TAU
from tractwise.plans.curves import curve_batch
from tractwise.plans.profiles import profile_batch
from tractwise.plans.tree import heatmap_matrix as tree_heatmap
from tractwise.plans.tree import tree_batch
from tractwise.session import scratch_path, settle
from tractwise.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SAMPLES = ["Day0_r0", "Day0_r1", "Day0_r2", "treated_r0", "treated_r1", "treated_r2"]
ROBUST = [f for f in FEATURES if not f.startswith("mix_")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str, name: str | None = None) -> Column:
    name = name or value
    source = F.col(value) if isinstance(value, str) else value
    return (F.round(source, 6) + F.lit(0.0)).alias(name)


# --- inputs shared by several queries -------------------------------------------------------

def _file_series(spark, sf):
    """Embedding series as files in long form: file, x, delta."""
    return fx.points(spark, sf).select(
        F.col("vec_id").cast("string").alias("file"), F.col("x").cast("double").alias("x"), "delta")


def _named_series(spark, sf):
    return fx.points(spark, sf).select(
        F.concat(F.lit("series_"), "vec_id").alias("dataset"), F.col("x").alias("pos"), "delta")


def _robust(spark, sf):
    rows = features.robust_features(features.usable_deltas(_named_series(spark, sf)))
    return rows.withColumn("true_label", col.tau_label(F.col("mean_delta"), NEUTRAL_TAU))


def _vectors(spark, sf):
    return fx.vectors(spark, sf).withColumn("cluster", F.col("label") % 3)


def _centers(spark, sf):
    return centers.mean_vectors(_vectors(spark, sf))


def _classes(spark, sf):
    """vec_id and its coarse label by the mean delta."""
    mean = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v) / F.size("vec")
    return fx.vectors(spark, sf).select(
        "vec_id", col.tau_label(mean, NEUTRAL_TAU).alias("true_label"))


def _bin_scores(spark, sf):
    """vec_id, x, y_bin, y_pred: observed bins against the centre of the own cluster."""
    own = centers.chosen_center(_vectors(spark, sf), _centers(spark, sf), "cluster")
    cells = F.arrays_zip(F.col("vec").alias("y_bin"), F.col("pred_vec").alias("y_pred"))
    return own.select("vec_id", F.posexplode(cells).alias("x", "_c")).select(
        "vec_id", "x", "_c.y_bin", "_c.y_pred",
        col.proxy_label(F.col("_c.y_bin"), BIN_TAU).alias("y"))


def _segment_sets(spark, sf):
    """Predicted segments (labels of the 3-point mean), true segments and all datasets."""
    every = settle(fx.series(spark, sf))
    base = series.smooth(every)
    twice = series.rolling_mean(base, "yf", "y3", 3, "extend").withColumn(
        "pred", col.tau_label(F.col("y3"), SEGMENT_TAU))
    pred = series.segments(twice, "pred", "delta")
    truth = series.truth_segments(every)
    return settle(pred), settle(truth), every.select("dataset").distinct()


# --- sources and sinks ----------------------------------------------------------------------

@query
def read_histograms(spark, sf):
    path = sinks.write_histograms(fx.histograms(spark, sf), scratch_path(spark, "histograms"))
    dataset = F.regexp_extract("file", r"^(.*)_(Day0|treated)_", 1)
    grp = F.regexp_extract("path", r"/grp=([^/]+)/", 1)
    rows = files.read_histograms(spark, path, dataset, grp, nested=True)
    return rows.select("dataset", "grp", "sample", "pos", "repeat_length", r6("reads"))


@query
def coerce_drop(spark, sf):
    number = F.regexp_extract("props", "([0-9]+)", 1)
    kind = F.col("event_id") % 5
    text = (F.when(kind == 0, F.col("props")).when(kind == 1, F.lit("")).when(kind == 2, F.lit("NaN"))
            .otherwise(number))
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.col("event_id").cast("string").alias("x"), text.alias("reads"))
    return histograms.coerce_numbers(rows, ["x", "reads"])


@query
def read_delta_csv(spark, sf):
    wide = delta.wide_delta(fx.histograms(spark, sf), SAMPLES)
    path = sinks.write_delta_csv(wide, scratch_path(spark, "delta"))
    read = files.delta_series(files.read_delta_files(spark, path, loose=True, nested=True))
    return read.select("dataset", "pos", "x", r6("delta"))


@query
def read_fasta(spark, sf):
    mark = F.when(F.col("grp") == "Day0", "d0").otherwise("treated")
    file = F.concat(F.col("dataset"), F.lit("_"), mark, F.lit(".fasta"))
    path = sinks.write_fasta(fx.reads(spark, sf), scratch_path(spark, "fasta"), file)
    return files.read_fasta(spark, path, nested=True).select("file", "grp", "read_id", "seq")


@query
def repeat_length_per_read(spark, sf):
    seq = F.col("seq")
    return fx.reads(spark, sf).select(
        "dataset", "grp", "sample", "read_id",
        reads.repeat_length(seq, profile="restrictive").alias("restrictive"),
        reads.repeat_length(seq, profile="permissive").alias("permissive"))


@query
def histogram_build(spark, sf):
    return reads.build_histogram(reads.read_lengths(fx.reads(spark, sf)))


@query
def classify_group(spark, sf):
    marks = ["d0", "D42", "untreated", "day42", "Day_0", "day_42", "plain"]
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("event_id") % 7 + 1).cast("int"))
    name = F.concat(F.lit("/in/s"), "event_id", F.lit("_"), mark, F.lit(".fasta"))
    return fx.table(spark, sf, "events").select(
        "event_id", name.alias("file"), col.file_group(name).alias("grp"))


@query
def partitioned_sink(spark, sf):
    path = sinks.write_histograms(fx.histograms(spark, sf), scratch_path(spark, "sink"), "permissive")
    rows = files.read_histograms(spark, path, grp=F.regexp_extract("path", r"/grp=([^/]+)/", 1),
                                 nested=True)
    return rows.groupBy(sinks.output_folder(F.col("grp")).alias("folder"), "sample").agg(
        F.count("*").alias("n_lengths"), r6(F.sum("reads"), "reads"))


@query
def wide_delta(spark, sf):
    wide = delta.wide_delta(fx.histograms(spark, sf), SAMPLES)
    numbers = [*SAMPLES, "Day0_avg", "treated_avg", "delta"]
    return wide.select("dataset", "repeat length", *[r6(c) for c in numbers])


@query
def instability_results(spark, sf):
    return sinks.results_text(histograms.instability(fx.histograms(spark, sf)))


# --- histograms, replicates and delta -------------------------------------------------------

@query
def normalize_minmax(spark, sf):
    return histograms.normalise(fx.histograms(spark, sf)).select(
        "dataset", "grp", "sample", "repeat_length", r6("y"))


@query
def normalize_percent(spark, sf):
    return histograms.normalise(fx.histograms(spark, sf), "percent").select(
        "dataset", "grp", "sample", "repeat_length", r6("y"))


@query
def valid_samples(spark, sf):
    return histograms.valid_samples(fx.histograms(spark, sf)).withColumn(
        "reads_range", r6("reads_range"))


@query
def sample_name(spark, sf):
    ends = [".rest.histogram", ".per.histogram", ".csv", ".v2.tsv"]
    end = F.element_at(F.array(*map(F.lit, ends)), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/out/"), "event_type", F.lit("/s"), "event_id", end)
    return fx.table(spark, sf, "events").select(
        "event_id", path.alias("path"), col.sample_name(path).alias("sample"))


@query
def instability_index(spark, sf):
    numbers = ["highest_peak", "instability_index", "contraction_index", "expansion_index"]
    return histograms.instability(fx.histograms(spark, sf)).select(
        "dataset", "grp", "sample", "mode", *[r6(c) for c in numbers])


@query
def peak_threshold_data(spark, sf):
    return histograms.peak_threshold(fx.histograms(spark, sf)).select(
        "dataset", "grp", "sample", "repeat_length", r6("reads"), r6("threshold"))


@query
def align_replicates(spark, sf):
    return delta.align_replicates(histograms.normalise(fx.histograms(spark, sf))).withColumn(
        "group_avg", r6("group_avg"))


@query
def delta_table(spark, sf):
    return fx.deltas(spark, sf).select(
        "dataset", "x", r6("day0_avg"), r6("treated_avg"), r6("delta"))


def _groups(spark, sf):
    return delta.aligned_groups(histograms.normalise(fx.histograms(spark, sf)))


@query
def within_error_sd(spark, sf):
    both = delta.replicate_error(_groups(spark, sf), "sd").withColumnRenamed("err", "err_compat")
    return delta.replicate_error(both, "sd", compat=False).select(
        "dataset", "x", r6("err_compat"), r6("err"))


@query
def within_error_sem(spark, sf):
    both = delta.replicate_error(_groups(spark, sf), "sem").withColumnRenamed("err", "err_compat")
    return delta.replicate_error(both, "sem", compat=False).select(
        "dataset", "x", r6("err_compat"), r6("err"))


@query
def band_labels(spark, sf):
    """Label of every length by the 95 % band of its replicates."""
    rows = delta.replicate_error(_groups(spark, sf), "sem")
    low, high = (F.col("delta") - 1.96 * F.col("err"), F.col("delta") + 1.96 * F.col("err"))
    return rows.select("dataset", "x", r6("delta"), col.band_label(low, high, SEGMENT_TAU).alias("label"))


@query
def between_set_error(spark, sf):
    sets = fx.with_sets(fx.deltas(spark, sf))
    return delta.between_sets(sets).select(
        "pair", "x", r6("delta_1"), r6("delta_2"), r6("sd"), r6("sem"))


@query
def thin_series(spark, sf):
    return delta.thin(fx.deltas(spark, sf)).select("dataset", "x", r6("delta"))


@query
def delta_plot_data(spark, sf):
    return delta.delta_plot(fx.with_sets(_groups(spark, sf)), "sd", view=(0, 200)).select(
        "pair", "set_id", "x", r6("delta"), r6("err"))


@query
def overlay_data(spark, sf):
    return delta.overlay(_groups(spark, sf)).select(
        "dataset", "x", r6("day0_avg"), r6("treated_avg"))


# --- series, segments -----------------------------------------------------------------------

@query
def smooth_delta(spark, sf):
    return series.smooth(fx.series(spark, sf)).select("dataset", "x", r6("delta"), r6("yf"))


@query
def smooth_extend(spark, sf):
    return series.rolling_mean(fx.series(spark, sf), "delta", "y3", 3, "extend").select(
        "dataset", "x", r6("y3"))


@query
def label_tau(spark, sf):
    return fx.series(spark, sf).select(
        "dataset", "x", col.tau_label(F.col("delta"), SEGMENT_TAU).alias("label"))


@query
def consensus_label(spark, sf):
    smoothed = series.smooth(fx.series(spark, sf))
    raw, soft = (col.tau_label(F.col(c), SEGMENT_TAU) for c in ("delta", "yf"))
    return smoothed.select("dataset", "x", col.agreed_label(raw, soft).alias("label"))


@query
def segments_truth(spark, sf):
    return series.truth_segments(fx.series(spark, sf)).select(
        "dataset", "label", "start_rl", "end_rl", "len", r6("mean_eff"), r6("max_abs"))


@query
def segment_summary(spark, sf):
    _, truth, datasets = _segment_sets(spark, sf)
    return series.segment_summary(truth, datasets)


@query
def segment_iou(spark, sf):
    pred, truth, _ = _segment_sets(spark, sf)
    return series.segment_iou(pred, truth).select(
        "dataset", "label", "start_rl", "end_rl", r6("score"), r6("best_iou"))


@query
def segment_curves(spark, sf):
    numbers = ["threshold", "precision", "recall", "fpr", "tpr"]
    return series.segment_curves(*_segment_sets(spark, sf)).select(
        "dataset", "label", "step", "tp", "fp", "fn", *[r6(c) for c in numbers])


@query
def segment_auc(spark, sf):
    pred, truth, datasets = _segment_sets(spark, sf)
    areas = series.segment_areas(series.segment_curves(pred, truth, datasets),
                                 series.segment_counts(pred, truth, datasets))
    return areas.select("dataset", "label", "n_pred", "n_truth", r6("auc_roc"), r6("auc_pr"))


@query
def gam_fit(spark, sf):
    return smoothers.spline_fit(fx.series(spark, sf))


@query
def gam_simultaneous_band(spark, sf):
    """The fit with the band that holds for all lengths of a series at once."""
    return smoothers.spline_fit(fx.series(spark, sf), simultaneous=True).select(
        "dataset", "x", "copy", r6("fit"), r6("se"), r6("lower"), r6("upper"), "label_fit", "status")


@query
def changepoint_labels(spark, sf):
    found = smoothers.changepoint_labels(fx.series(spark, sf), standardize=True)
    return found.select("dataset", "x", "copy", r6("yf"), r6("y3"), "cp_segment", r6("cp_mean"), "label_cp")


@query
def segments_all(spark, sf):
    return curve_batch(fx.series(spark, sf)).segments


@query
def gam_metrics(spark, sf):
    return curve_batch(fx.series(spark, sf)).metrics


@query
def signal_panel_data(spark, sf):
    return curve_batch(fx.series(spark, sf)).panel


# --- features, split, scaling ---------------------------------------------------------------

@query
def usable_deltas(spark, sf):
    return features.usable_deltas(_named_series(spark, sf)).select(
        "dataset", "pos", F.col("rank").cast("bigint").alias("rank"),
        F.col("n").cast("bigint").alias("n"), r6("delta"))


@query
def dataset_features(spark, sf):
    return _robust(spark, sf).select("dataset", "n", *[r6(c) for c in ROBUST], "true_label")


@query
def mixture_features(spark, sf):
    return features.mixture_features(features.usable_deltas(_named_series(spark, sf)))


@query
def feature_matrix(spark, sf):
    return features.dataset_features(_named_series(spark, sf)).select("dataset", *FEATURES)


@query
def first_datasets(spark, sf):
    return features.first_datasets(features.usable_deltas(_named_series(spark, sf)))


@query
def train_test_split(spark, sf):
    return split.stratified_split(_classes(spark, sf), "vec_id")


@query
def impute_median(spark, sf):
    gaps = settle(_robust(spark, sf)).select("dataset", *[
        F.when(F.col("prop_pos") <= 0.55, F.col(c)).alias(c)
        for c in ("mean_delta", "sd_delta", "skew_delta")])
    names = ["mean_delta", "sd_delta", "skew_delta"]
    return split.impute_median(gaps, names).select("dataset", *[r6(c) for c in names])


@query
def zscore_train(spark, sf):
    parts = split.stratified_split(_classes(spark, sf), "vec_id")
    vectors = fx.vectors(spark, sf).select("vec_id", "vec")
    stats = bins.vector_stats(split.members(vectors, parts, "train", "vec_id"))
    scaled = bins.scale_vectors(vectors, stats)
    return scaled.select("vec_id", F.posexplode("z").alias("x", "z")).withColumn("z", r6("z"))


@query
def zscore_matrix_all(spark, sf):
    rows = settle(_robust(spark, sf))
    parts = split.stratified_split(rows)
    stats = split.column_stats(split.members(rows, parts, "train"), ROBUST)
    z = split.standardise(rows.join(parts.select("dataset", "split"), "dataset"), stats, ROBUST)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), r6(c, "z")) for c in ROBUST])
    return z.select("dataset", F.concat_ws(" / ", "split", "true_label").alias("split_label"),
                    F.inline(cells))


@query
def delta_distribution(spark, sf):
    rows = settle(_robust(spark, sf))
    parts = split.stratified_split(rows).select("dataset", "split")
    means = features.equal_width_counts(rows.join(parts, "dataset"), "mean_delta", 20, ("split",))
    small = features.small_multiples(features.usable_deltas(_named_series(spark, sf)))
    return means.select(F.concat(F.lit("mean / "), "split").alias("panel"), "bin", "n").unionByName(
        small.select(F.col("dataset").alias("panel"), "bin", "n"))


# --- bins, centres, clusters ----------------------------------------------------------------

@query
def bin_grid(spark, sf):
    return bins.fit_grid(_file_series(spark, sf), 2.0).frame(spark)


@query
def bin_series(spark, sf):
    points = _file_series(spark, sf)
    return bins.assign_bins(points, bins.fit_grid(points, 3.0)).select("file", "x", "bin")


@query
def bin_means(spark, sf):
    points = _file_series(spark, sf)
    vectors = bins.bin_means(points, bins.fit_grid(points, 3.0))
    return vectors.select("file", F.posexplode("vec").alias("_i", "value")).select(
        "file", (F.col("_i") + 1).alias("bin"), r6("value"))


@query
def cluster_centers(spark, sf):
    typed = centers.center_types(_centers(spark, sf), 0.0005)
    return typed.select("cluster", "cluster_type", F.posexplode("center").alias("x", "value")).select(
        "cluster", "cluster_type", "x", r6("value"))


@query
def cluster_centroids(spark, sf):
    vectors = fx.vectors(spark, sf)
    z = bins.scale_vectors(vectors, bins.vector_stats(vectors)).withColumn(
        "cluster", F.col("label") % 2)
    return centers.mean_vectors(z, vec="z").select(
        "cluster", F.posexplode("center").alias("x", "value")).select("cluster", "x", r6("value"))


def _two_sides(spark, sf):
    vectors = fx.vectors(spark, sf).withColumn("cluster", F.col("label") % 2)
    means = centers.mean_vectors(vectors)
    return centers.nearest_centroid(
        vectors, means.filter("cluster = 1"), means.filter("cluster = 0"))


@query
def nearest_centroid(spark, sf):
    return _two_sides(spark, sf).select("vec_id", r6("d_exp"), r6("d_con"), r6("score"), "pred")


@query
def confusion_table(spark, sf):
    joined = _two_sides(spark, sf).join(_classes(spark, sf), "vec_id")
    return centers.confusion(joined.withColumnRenamed("pred", "pred_cluster"))


@query
def soft_membership(spark, sf):
    rows = centers.center_distances(_vectors(spark, sf), _centers(spark, sf))
    return rows.select("vec_id", F.inline(centers.memberships())).select(
        "vec_id", "cluster", r6("weight"))


@query
def predict_bins(spark, sf):
    means = _centers(spark, sf)
    rows = centers.center_distances(_vectors(spark, sf).drop("cluster"), means).withColumn(
        "cluster", centers.nearest()).withColumn("probs", centers.memberships())
    both = centers.weighted_centers(centers.chosen_center(rows, means, "cluster", "hard"),
                                    means, "probs", "soft")
    cells = F.arrays_zip("hard", "soft")
    return both.select("vec_id", "cluster", F.posexplode(cells).alias("x", "_c")).select(
        "vec_id", "cluster", "x", r6(F.col("_c.hard"), "hard"), r6(F.col("_c.soft"), "soft"))


@query
def silhouette(spark, sf):
    rows = fx.vectors(spark, sf).withColumn("cluster", F.col("label") % 2)
    return hierarchy.silhouettes(rows, "vec_id", "cluster", "vec").select(
        "vec_id", "cluster", r6("a"), r6("b"), r6("width"))


@query
def proxy_labels(spark, sf):
    value = F.col("delta")
    return fx.points(spark, sf).select(
        "vec_id", "x", col.proxy_label(value, BIN_TAU).alias("y_exp"),
        col.proxy_label(value, BIN_TAU, "contraction").alias("y_con"))


@query
def kmeans_train(spark, sf):
    points = _file_series(spark, sf)
    return clusters.train_assignments(points, clusters.train_model(points, "kmeans"))


def _start_centers(spark, sf, k):
    """Means of the vectors whose label leaves the same remainder, one per remainder."""
    rows = centers.mean_vectors(fx.vectors(spark, sf).withColumn("cluster", F.col("label") % k))
    return [r["center"] for r in rows.orderBy("cluster").collect()]


@query
def kmeans_steps(spark, sf):
    """Centres after four passes from fixed starts."""
    fit = clusters.kmeans_from(fx.vectors(spark, sf), _start_centers(spark, sf, 3), 4, "vec")
    rows = [(i, x, float(v)) for i, c in enumerate(fit.means, 1) for x, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, x int, value double").select("cluster", "x", r6("value"))


@query
def mixture_steps(spark, sf):
    """Weights, means and variances after three passes of EM from fixed starts."""
    fit = clusters.mixture_from(fx.vectors(spark, sf), _start_centers(spark, sf, 3), "VVI", 3, 0.0, "vec")
    rows = [(i + 1, x, float(fit.weights[i]), float(fit.means[i, x]), float(fit.variances[i, x]))
            for i in range(fit.k) for x in range(fit.means.shape[1])]
    return spark.createDataFrame(rows, "cluster int, x int, weight double, mean double, variance double").select(
        "cluster", "x", r6("weight"), r6("mean"), r6("variance"))


@query
def gmm_bic(spark, sf):
    vectors = bins.scale_vectors(*_emb_stats(spark, sf)).select("vec_id", "z")
    return clusters.bic_table(spark, clusters.mixture_fits(
        settle(vectors), range(1, 10)))


def _emb_stats(spark, sf):
    vectors = fx.vectors(spark, sf)
    return vectors, bins.vector_stats(vectors)


@query
def gmm_train(spark, sf):
    points = _file_series(spark, sf)
    return clusters.train_assignments(points, clusters.train_model(points, "gmm", 3, False))


@query
def model_roundtrip(spark, sf):
    points = _file_series(spark, sf)
    model = clusters.train_model(points, "gmm", 3, False)
    path = clusters.save_model(spark, model, scratch_path(spark, "model"))
    return clusters.bin_predictions(points, clusters.load_model(spark, path))


def _trained(spark, sf, method, **options):
    """Train on the training files, score the test files."""
    parts = split.stratified_split(_classes(spark, sf).withColumn(
        "file", F.col("vec_id").cast("string")), "file")
    points = _file_series(spark, sf)
    return profile_batch(split.members(points, parts, "train", "file"),
                         split.members(points, parts, "test", "file"), method, **options)


@query
def cluster_test_metrics(spark, sf):
    return _trained(spark, sf, "kmeans").metrics


@query
def cluster_overall_auc(spark, sf):
    return _trained(spark, sf, "gmm", k=3, auto_select_k=False).overall()


@query
def cluster_panel_data(spark, sf):
    """Signal, bin means, predicted steps and caption of every test file, as the figures show them."""
    return _trained(spark, sf, "kmeans").panel.select("file", "layer", "x", "x_end", r6("value"), "caption")


@query
def cluster_file_curves(spark, sf):
    return _trained(spark, sf, "kmeans").curves().select(
        "file", "side", r6("threshold"), r6("fpr"), r6("tpr"))


@query
def gmm_covariances(spark, sf):
    """Mixtures of 2 and 3 clusters in every family of whole covariances, 40 passes at most."""
    vectors = settle(bins.scale_vectors(*_emb_stats(spark, sf)).select("vec_id", "z"))
    families = clusters.FULL_FAMILIES + clusters.COMMON_AXES
    return clusters.bic_table(spark, clusters.mixture_fits(vectors, [2, 3], families, max_iter=40))


@query
def hca_train(spark, sf):
    return tree_batch(_named_series(spark, sf)).train.select("dataset", "cluster", "cluster_name")


@query
def hca_merges(spark, sf):
    return tree_batch(_named_series(spark, sf)).merges


@query
def hca_result_table(spark, sf):
    return tree_batch(_named_series(spark, sf)).results


def _robust_points(spark, sf):
    """Standardised robust features of all datasets, numbered."""
    rows = settle(_robust(spark, sf))
    stats = split.column_stats(split.members(rows, split.stratified_split(rows), "train"), ROBUST)
    z = split.standardise(rows, stats, ROBUST)
    return settle(hierarchy.number_ids(z.select("dataset", F.array(*ROBUST).alias("vec")), "dataset"))


@query
def hca_merges_by_rounds(spark, sf):
    """The tree of all datasets, every merge of it made by the distributed rounds."""
    merges = hierarchy.ward_merges(_robust_points(spark, sf), "vec", local_limit=1)
    return merges.select("a", "b", "into", r6("height"), "size")


@query
def hca_rounds(spark, sf):
    """Clusters and comparisons of every round of that tree."""
    rounds: list[tuple[int, int, int]] = []
    hierarchy.ward_merges(_robust_points(spark, sf), "vec", local_limit=1, rounds=rounds)
    return spark.createDataFrame(rounds, "round int, clusters long, compared long")


@query
def hca_leaf_order(spark, sf):
    """Where every dataset stands in the drawing of that tree."""
    points = _robust_points(spark, sf)
    return points.select("id", "dataset").join(hierarchy.leaf_order(hierarchy.ward_merges(points), points), "id")


@query
def heatmap_matrix(spark, sf):
    batch = tree_batch(_named_series(spark, sf))
    return tree_heatmap(batch.z_all, FEATURES).select(
        "dataset", "split_label", "feature", r6("z"), F.col("row_rank"), F.col("col_rank"))


def _saved(spark, tables, name):
    path = sinks.write_batch(tables, scratch_path(spark, name))
    parts = [t.select(F.lit(n).alias("file"), F.to_json(F.struct("*")).alias("line")) for n, t in sinks.read_batch(spark, path).items()]
    return reduce(DataFrame.unionByName, parts)


@query
def curve_outputs(spark, sf):
    return _saved(spark, curve_batch(fx.series(spark, sf)).outputs(), "curves")


@query
def profile_outputs(spark, sf):
    return _saved(spark, _trained(spark, sf, "kmeans").outputs(), "profiles")


@query
def tree_outputs(spark, sf):
    return _saved(spark, tree_batch(_named_series(spark, sf)).outputs(), "tree")


# --- evaluation -----------------------------------------------------------------------------

@query
def auc_per_dataset(spark, sf):
    return evaluate.auc(_bin_scores(spark, sf), ["vec_id"], "y", "y_pred").select(
        "vec_id", "n_pos", "n_neg", r6("auc"))


@query
def auc_fixed_direction(spark, sf):
    return evaluate.auc(_bin_scores(spark, sf), ["vec_id"], "y", "y_pred").select(
        "vec_id", r6("auc_fixed"))


@query
def auc_ci(spark, sf):
    return evaluate.auc(_bin_scores(spark, sf), ["vec_id"], "y", "y_pred").select(
        "vec_id", r6("ci_low"), r6("ci_high"))


@query
def roc_curve(spark, sf):
    return evaluate.roc_points(_bin_scores(spark, sf), ["vec_id"], "y", "y_pred").select(
        "vec_id", r6("threshold"), r6("fpr"), r6("tpr"))


@query
def roc_overall(spark, sf):
    return evaluate.roc_points(_bin_scores(spark, sf), [], "y", "y_pred").select(
        r6("threshold"), r6("fpr"), r6("tpr"))


@query
def auc_overall(spark, sf):
    return evaluate.auc(_bin_scores(spark, sf), [], "y", "y_pred").select(
        "n_pos", "n_neg", *[r6(c) for c in ("auc", "auc_fixed", "ci_low", "ci_high")])


# --- scalar and set functions ---------------------------------------------------------------

@query
def set_ops(spark, sf):
    sets = fx.with_sets(fx.deltas(spark, sf))
    one, two = (sets.filter(F.col("set_id") == i).select("pair", "x") for i in (1, 2))
    both = one.intersect(two).withColumn("op", F.lit("intersect"))
    gone = one.join(two, ["pair", "x"], "left_anti").withColumn("op", F.lit("setdiff"))
    every = sets.select("pair", "x").distinct().withColumn("op", F.lit("unique"))
    return both.unionByName(gone).unionByName(every)


@query
def string_ops(spark, sf):
    path = F.concat(F.lit("/d/Day0_"), "event_type", F.lit("_"), "event_id", F.lit(".CSV"))
    return fx.table(spark, sf, "events").select(
        "event_id", col.base_name(path).alias("base"), col.extension(col.base_name(path)).alias("ext"),
        col.stem(col.base_name(path)).alias("stem"),
        col.base_name(path).startswith("Day0_").alias("is_day0"),
        (F.lower(F.trim(F.concat(F.lit(" "), "event_type"))) == "click").alias("is_click"),
        F.format_string("AUC = %.3f", "value").alias("auc_text"),
        F.concat(F.format_string("%.2f", "value"), F.lit("%")).alias("percent"))


@query
def math_ops(spark, sf):
    v = F.col("value")
    return fx.table(spark, sf, "events").select(
        "event_id", r6(F.sqrt(F.abs(v)), "root"), F.floor(v).cast("bigint").alias("low"),
        F.ceil(v).cast("bigint").alias("high"), r6(F.least(v, F.lit(10.0)), "capped"),
        r6(F.greatest(v, F.lit(10.0)), "raised"), r6(F.log(F.abs(v) + 1), "logged"),
        F.bround(v * 2, 0).alias("even"))
