"""ROC analysis from rank statistics.

Everything starts from one row per distinct score with its number of cases and controls, so
repeated scores shrink before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractwise.functions.ranks import bucket_of, cut_points, running_sums

Z95 = 1.959963984540054  # 97.5 % quantile of the standard normal


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Cases and controls per distinct score; incomplete rows do not count."""
    complete = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()
                         & ~F.isnan(F.col(score).cast("double")))
    return complete.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def ranked_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Adds ``cum_pos`` and ``cum_neg``, the counts up to and including each score.

    With keys (one series each, bounded by its bins) a plain window does it; the pooled case
    has no key and goes through bucketed running sums.
    """
    counts = score_counts(df, keys, label, score)
    if keys:
        upto = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("*", F.sum("pos").over(upto).alias("cum_pos"),
                             F.sum("neg").over(upto).alias("cum_neg"))
    cuts = cut_points(counts, "score")
    return running_sums(counts.withColumn("_b", bucket_of(F.col("score"), cuts)), [], "score",
                        "_b", ["pos", "neg"]).drop("_b")


def _with_totals(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    if keys:
        total = Window.partitionBy(*keys)
        return ranked.select("*", F.sum("pos").over(total).alias("n_pos"),
                             F.sum("neg").over(total).alias("n_neg"))
    totals = ranked.agg(F.struct(*sums)).scalar()
    return ranked.select("*", totals["n_pos"].alias("n_pos"), totals["n_neg"].alias("n_neg"))


def _median_of(count: str, cum: str, size: str) -> Column:
    """Exact median of one class, read off the running counts."""
    def nth(n: Column) -> Column:
        return F.min(F.when((F.col(cum) >= n) & (F.col(count) > 0), F.col("score")))

    half = (F.col(size) + 1) / 2
    return (nth(F.floor(half)) + nth(F.ceil(half))) / 2


def auc(df: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """One row per key: counts, the automatic and the fixed-direction area, and its 95 % interval.

    ``auc`` turns the direction when controls score higher by their median. ``auc_fixed`` always
    reads lower scores as cases, and ``ci_low``/``ci_high`` (DeLong) belong to it. Areas are NULL
    unless both classes occur.
    """
    rows = _with_totals(ranked_counts(df, keys, label, score), keys)
    below = F.col("cum_neg") - F.col("neg") / 2
    above = F.col("n_pos") - F.col("cum_pos") + F.col("pos") / 2
    case_place, control_place = below / F.col("n_neg"), above / F.col("n_pos")
    both = rows.filter("n_pos > 0 AND n_neg > 0")
    summed = both.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        (F.sum(F.col("pos") * below) / F.max(F.col("n_pos") * F.col("n_neg"))).alias("_up"),
        F.sum(F.col("pos") * case_place).alias("_s1"),
        F.sum(F.col("pos") * case_place * case_place).alias("_q1"),
        F.sum(F.col("neg") * control_place).alias("_s0"),
        F.sum(F.col("neg") * control_place * control_place).alias("_q0"),
        _median_of("pos", "cum_pos", "n_pos").alias("_m1"),
        _median_of("neg", "cum_neg", "n_neg").alias("_m0"))

    def variance(q: str, s: str, n: str) -> Column:
        n_col = F.col(n)
        spread = F.greatest(F.col(q) - F.col(s) * F.col(s) / n_col, F.lit(0.0))
        return F.when(n_col > 1, spread / (n_col - 1) / n_col)

    se = F.sqrt(variance("_q1", "_s1", "n_pos") + variance("_q0", "_s0", "n_neg"))
    fixed = 1 - F.col("_up")
    out = summed.select(
        *keys, "n_pos", "n_neg",
        F.when(F.col("_m0") > F.col("_m1"), fixed).otherwise(F.col("_up")).alias("auc"),
        fixed.alias("auc_fixed"),
        F.greatest(F.lit(0.0), fixed - Z95 * se).alias("ci_low"),
        F.least(F.lit(1.0), fixed + Z95 * se).alias("ci_high"))
    if not keys:
        return out
    everyone = df.select(*keys).distinct()
    return everyone.join(out, list(keys), "left")


def roc_points(df: DataFrame, keys: Sequence[str] = (), label: str = "y", score: str = "score",
               fixed: bool = True) -> DataFrame:
    """Curve points per threshold, the open end included; only keys with both classes.

    With ``fixed`` a score at or below the threshold is called a case, otherwise one at or above.
    """
    rows = _with_totals(ranked_counts(df, keys, label, score), keys).filter(
        "n_pos > 0 AND n_neg > 0")
    hits, alarms = F.col("cum_pos"), F.col("cum_neg")
    if not fixed:
        hits = F.col("n_pos") - F.col("cum_pos") + F.col("pos")
        alarms = F.col("n_neg") - F.col("cum_neg") + F.col("neg")
    curve = rows.select(*keys, F.col("score").alias("threshold"),
                        (alarms / F.col("n_neg")).alias("fpr"), (hits / F.col("n_pos")).alias("tpr"))
    null = F.lit(None).cast("double")
    origin = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 0").select(
        *keys, null.alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)
