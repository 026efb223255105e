"""Train/test split, imputation and scaling with training statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.functions.columns import is_finite
from tractwise.functions.ranks import exact_quantiles, hash_rank
from tractwise.params import CONTRACTION, EXPANSION, TRAIN_SHARE


def stratified_split(features: DataFrame, id_col: str = "dataset", label: str = "true_label",
                     share: float = TRAIN_SHARE, salt: str = "") -> DataFrame:
    """id, label and ``split``: each class gives its rounded share, neutral fills up the rest.

    The draw is the order of the md5 of the id, so it is the same on every run. What the classes
    cannot supply is topped up from the rows not yet drawn, in the same order.
    """
    rows = features.select(id_col, label)
    sizes = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == EXPANSION).alias("exp"),
        F.count_if(F.col(label) == CONTRACTION).alias("con")).first()
    n = sizes["n"]
    train = max(1, int(share * n))
    k_exp = min(sizes["exp"], round(train * (sizes["exp"] / n))) if n else 0
    k_con = min(sizes["con"], round(train * (sizes["con"] / n))) if n else 0
    k_neu = min(n - sizes["exp"] - sizes["con"], max(0, train - k_exp - k_con))
    short = train - k_exp - k_con - k_neu
    quota = F.when(F.col(label) == EXPANSION, k_exp).when(
        F.col(label) == CONTRACTION, k_con).otherwise(k_neu)
    ranked = hash_rank(rows, [label], id_col, "_rank", salt)
    if short <= 0:
        return ranked.select(id_col, label, F.when(F.col("_rank") <= quota, "train").otherwise("test").alias("split"))
    drawn = ranked.filter(F.col("_rank") <= quota).withColumn("split", F.lit("train"))
    rest = hash_rank(ranked.filter(F.col("_rank") > quota), [], id_col, "_again", salt)
    topped = rest.withColumn(
        "split", F.when(F.col("_again") <= short, "train").otherwise("test"))
    return drawn.select(id_col, label, "split").unionByName(topped.select(id_col, label, "split"))


def members(df: DataFrame, split: DataFrame, part: str, id_col: str = "dataset") -> DataFrame:
    """Rows of the training ids; the test rows are all the others."""
    train = split.filter(F.col("split") == "train").select(id_col)
    return df.join(train, id_col, "left_semi" if part == "train" else "left_anti")


def impute_median(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and non-finite cells take the column's exact median, 0 where there is none."""
    gaps = matrix.agg(*[F.count_if(~is_finite(F.col(c))).alias(c) for c in columns]).first()
    holed = [c for c in columns if gaps[c]]
    if not holed:
        return matrix
    clean = [F.when(is_finite(F.col(c)), F.col(c).cast("double")).alias(c) for c in holed]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in holed])
    long = matrix.select(*clean).select(F.inline(pairs))
    medians = {r["feature"]: r["q0"]
               for r in exact_quantiles(long, "feature", "value", [0.5]).collect()}
    return matrix.withColumns({
        c: F.when(is_finite(F.col(c)), F.col(c)).otherwise(
            0.0 if medians.get(c) is None else medians[c]) for c in holed})


def column_stats(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation per column; a useless deviation becomes 1."""
    parts = []
    for c in columns:
        sd = F.stddev_samp(c)
        parts += [F.avg(c).alias(f"mean_{c}"),
                  F.when(is_finite(sd) & (sd != 0), sd).otherwise(1.0).alias(f"sd_{c}")]
    return matrix.agg(*parts)


def standardise(matrix: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the given (training) statistics, a handful of numbers."""
    row = stats.first()
    others = [c for c in matrix.columns if c not in columns]
    return matrix.select(*others, *[
        ((F.col(c) - row[f"mean_{c}"]) / row[f"sd_{c}"]).alias(c) for c in columns])
