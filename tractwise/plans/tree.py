"""Features, split, Ward clustering and nearest-centroid scoring for a table of delta series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.operators.centers import (confusion, mean_vectors, name_by_mean,
                                         nearest_centroid)
from tractwise.operators.evaluate import auc
from tractwise.operators.features import dataset_features
from tractwise.operators.hierarchy import leaf_order, number_ids, silhouettes, ward_cut, ward_merges
from tractwise.operators.split import (column_stats, impute_median, members, standardise,
                                       stratified_split)
from tractwise.params import FEATURES
from tractwise.session import settle


@dataclass
class TreeBatch:
    features: DataFrame
    merges: DataFrame
    train: DataFrame
    test: DataFrame
    auc: DataFrame
    confusion: DataFrame
    silhouette: DataFrame
    z_all: DataFrame
    results: DataFrame

    def outputs(self) -> dict[str, DataFrame]:
        """The table that a batch saves, by file name."""
        return {"HCA_per_dataset_features_and_results.csv": self.results}


def feature_columns(features: DataFrame, wanted: list[str] = FEATURES) -> list[str]:
    present = [c for c in wanted if c in features.columns]
    if len(present) < 2:
        raise ValueError("too few feature columns")
    return present


def _as_vectors(z: DataFrame, columns: list[str]) -> DataFrame:
    return z.withColumn("vec", F.array(*columns))


def tree_batch(series: DataFrame, salt: str = "", local_limit: int = 2000,
               **feature_options) -> TreeBatch:
    """The whole batch. ``series`` has dataset, pos and delta."""
    features = settle(dataset_features(series, **feature_options))
    split = settle(stratified_split(features, salt=salt))
    columns = feature_columns(features)
    marked = features.join(split.select("dataset", "split"), "dataset")
    train = impute_median(members(features, split, "train"), columns)
    test = impute_median(members(features, split, "test"), columns)
    stats = column_stats(train, columns)
    z_train = settle(number_ids(_as_vectors(standardise(train, stats, columns), columns), "dataset"))
    z_test = _as_vectors(standardise(test, stats, columns), columns)
    z_all = _as_vectors(standardise(impute_median(marked, columns), stats, columns), columns)

    merges = ward_merges(z_train, "vec", local_limit)
    labelled = z_train.join(ward_cut(z_train, merges), "id")
    raw_means = labelled.select("dataset", "cluster", "vec").join(
        features.select("dataset", "mean_delta"), "dataset")
    names = name_by_mean(raw_means)
    centers = settle(mean_vectors(labelled).join(names.select("cluster", "cluster_name"), "cluster"))
    train_out = settle(labelled.join(names.select("cluster", "cluster_name"), "cluster").select(
        "id", "dataset", "cluster", "cluster_name", "vec"))
    scored = nearest_centroid(
        z_test, centers.filter("cluster_name = 'expansion'"),
        centers.filter("cluster_name = 'contraction'"))
    test_out = settle(scored.select("dataset", "true_label", F.col("pred").alias("pred_cluster"),
                                    "d_exp", "d_con", "score"))
    sides = test_out.filter("true_label <> 'neutral'").withColumn(
        "y", (F.col("true_label") == "expansion").cast("int"))
    results = marked.join(test_out.select("dataset", "pred_cluster", "score"), "dataset", "left")
    return TreeBatch(
        features, merges, train_out, test_out, auc(sides),
        confusion(test_out), silhouettes(train_out, "dataset", "cluster", "vec"),
        z_all.withColumn("split_label", F.concat_ws(" / ", "split", "true_label")), results)


def complete_linkage_order(distances: np.ndarray) -> list[int]:
    """Leaf order of a complete-linkage tree of a handful of items, the lower branch on the left."""
    branches = {i: (0.0, (i,)) for i in range(len(distances))}
    far = {(i, j): float(distances[i, j]) for i, j in combinations(range(len(distances)), 2)}
    while len(branches) > 1:
        (i, j), height = min(far.items(), key=lambda item: (item[1], item[0]))
        low, high = sorted((branches.pop(i), branches.pop(j)))
        new = max([*branches, i, j]) + 1
        for k in branches:
            far[(k, new)] = max(far[tuple(sorted((i, k)))], far[tuple(sorted((j, k)))])
        far = {pair: d for pair, d in far.items() if i not in pair and j not in pair}
        branches[new] = (height, low[1] + high[1])
    return list(next(iter(branches.values()))[1]) if branches else []


def heatmap_matrix(z: DataFrame, columns: Sequence[str], labels: Sequence[str] = ("split_label",), local_limit: int = 2000) -> DataFrame:
    """Every standardised feature of every dataset, with the places of both in their trees.

    ``z`` has dataset, the columns and the labels. Rows are ranked by the Ward tree over all datasets,
    columns by the complete-linkage tree of the features' distances, which are sums over the rows.
    """
    columns = list(columns)
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    points = settle(number_ids(z.select("dataset", *labels, *columns, F.array(*values).alias("vec")), "dataset"))
    ranks = leaf_order(ward_merges(points, "vec", local_limit), points).withColumnRenamed("rank", "row_rank")
    pairs = list(combinations(range(len(columns)), 2))
    gaps = [F.sum(F.pow(values[i] - values[j], 2)).alias(f"d{i}_{j}") for i, j in pairs]
    row = points.agg(F.count("*").alias("n"), *gaps).first()
    distances = np.zeros((len(columns), len(columns)))
    for (i, j), total in zip(pairs, row[1:]):
        distances[i, j] = distances[j, i] = (total or 0.0) ** 0.5
    place = {at: rank for rank, at in enumerate(complete_linkage_order(distances), start=1)}
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("z"), F.lit(place[i]).alias("col_rank"))
                      for i, c in enumerate(columns)])
    return points.join(ranks, "id").select("dataset", *labels, "row_rank", F.inline(cells))
