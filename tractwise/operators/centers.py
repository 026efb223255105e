"""Distances to a small set of centres and what follows from them.

Centres are a table (cluster, center ARRAY) with one row per cluster. They reach every row as one
scalar array, so scoring never shuffles the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.functions.columns import cluster_type, euclid
from tractwise.params import BIN_TAU, CONTRACTION, EXPANSION


def mean_vectors(df: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """Column means per cluster, partially aggregated on the map side."""
    cells = df.select(F.col(cluster).alias("cluster"), F.posexplode(vec).alias("_i", "_v"))
    means = cells.groupBy("cluster", "_i").agg(F.avg("_v").alias("_v"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    return means.groupBy("cluster").agg(
        F.transform(ordered, lambda c: c["_v"]).alias("center"))


def center_types(centers: DataFrame, tau: float = BIN_TAU) -> DataFrame:
    total = F.aggregate("center", F.lit(0.0), lambda acc, v: acc + v)
    mean = total / F.size("center")
    return centers.withColumn("center_mean", mean).withColumn(
        "cluster_type", cluster_type(F.col("center_mean"), tau))


def name_by_mean(df: DataFrame, cluster: str = "cluster", value: str = "mean_delta") -> DataFrame:
    """The cluster with the highest mean is the expansion one, ties go to the lower number."""
    means = df.groupBy(cluster).agg(F.avg(value).alias("avg_mean_delta"))
    best = means.agg(F.max_by(cluster, F.struct("avg_mean_delta", -F.col(cluster)))).scalar()
    return means.withColumn(
        "cluster_name", F.when(F.col(cluster) == best, EXPANSION).otherwise(CONTRACTION))


def center_array(centers: DataFrame) -> Column:
    """All centres as one sorted scalar array of structs (cluster, center)."""
    return centers.agg(F.sort_array(F.collect_list(F.struct("cluster", "center")))).scalar()


def center_distances(df: DataFrame, centers: DataFrame, vec: str = "vec",
                     out: str = "dists") -> DataFrame:
    """Array of (cluster, dist), sorted by cluster."""
    return df.withColumn("_centers", center_array(centers)).withColumn(
        out, F.transform("_centers", lambda c: F.struct(
            c["cluster"].alias("cluster"), euclid(F.col(vec), c["center"]).alias("dist")))
    ).drop("_centers")


def nearest(dists: str = "dists") -> Column:
    """Cluster of the smallest distance; the first one on ties."""
    best = F.array_min(F.transform(dists, lambda d: F.struct(d["dist"], d["cluster"])))
    return best["cluster"]


def memberships(dists: str = "dists") -> Column:
    """Inverse squared distances, normalised to 1 (array of (cluster, weight))."""
    weights = F.transform(dists, lambda d: 1 / (d["dist"] * d["dist"] + 1e-6))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.zip_with(dists, weights, lambda d, w: F.struct(
        d["cluster"].alias("cluster"), (w / total).alias("weight")))


def nearest_centroid(df: DataFrame, expansion: DataFrame, contraction: DataFrame,
                     vec: str = "vec") -> DataFrame:
    """Scores against two one-row centre tables: higher means more expansion-like."""
    both = df.withColumn("_exp", expansion.select("center").scalar()).withColumn(
        "_con", contraction.select("center").scalar())
    scored = both.withColumn("d_exp", euclid(F.col(vec), F.col("_exp"))).withColumn(
        "d_con", euclid(F.col(vec), F.col("_con"))).drop("_exp", "_con")
    return scored.withColumn("score", F.col("d_con") - F.col("d_exp")).withColumn(
        "pred", F.when(F.col("d_exp") < F.col("d_con"), EXPANSION).otherwise(CONTRACTION))


def weighted_centers(df: DataFrame, centers: DataFrame, probs: str, out: str = "pred_vec") -> DataFrame:
    """Posterior-weighted sum of the centres per row."""
    def add(acc: Column, pair: Column) -> Column:
        scaled = F.transform(pair["c"]["center"], lambda v: v * pair["p"]["weight"])
        return F.zip_with(acc, scaled, lambda a, b: F.coalesce(a, F.lit(0.0)) + b)

    pairs = F.zip_with(probs, "_centers", lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    return df.withColumn("_centers", center_array(centers)).withColumn(
        out, F.aggregate(pairs, F.expr("cast(array() as array<double>)"), add)).drop("_centers")


def chosen_center(df: DataFrame, centers: DataFrame, cluster: str, out: str = "pred_vec") -> DataFrame:
    """The centre of each row's own cluster."""
    picked = F.filter("_centers", lambda c: c["cluster"] == F.col(cluster))
    return df.withColumn("_centers", center_array(centers)).withColumn(
        out, F.element_at(picked, 1)["center"]).drop("_centers")


def confusion(df: DataFrame, truth: str = "true_label", pred: str = "pred_cluster") -> DataFrame:
    """Counts of every (truth, prediction) pair of the two sides, zero included."""
    sides = [CONTRACTION, EXPANSION]
    counts = df.filter(F.col(truth).isin(*sides)).groupBy(truth, pred).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, p) for t in sides for p in sides], [truth, pred])
    return grid.join(counts, [truth, pred], "left").select(
        truth, pred, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
