"""Running sums, exact quantiles and hash ranks over whole tables.

A window without a partition key would sort everything in one task. The helpers here cut the
ordered column into buckets, sum inside each bucket in parallel and add the totals of the
buckets before it; only the bucket totals, whose number is fixed, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_points(df: DataFrame, value: str, buckets: int = 64) -> list[float]:
    """Approximate quantiles of a column, found by one small job. They only balance the work."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, shares, 10000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below the value, as a balanced tree of comparisons."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, bucket: str,
                 sums: Sequence[str], few_buckets: bool = True) -> DataFrame:
    """Add ``cum_<name>`` for every name: the sum over rows of the key up to and including this one.

    ``bucket`` must be non-decreasing in ``order`` inside a key. With ``few_buckets`` the number
    of (key, bucket) pairs is known to be small and their totals are broadcast.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    starts = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    summed = df.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums])
    joined = summed.join(F.broadcast(starts) if few_buckets else starts, [*keys, bucket])
    return joined.select(*df.columns, *[
        (F.col(f"_i_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def exact_quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float],
                    buckets: int = 16) -> DataFrame:
    """Type-7 quantiles per key, for a handful of keys that may each hold very many rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count("*").alias("_n"))
    grid = [i / buckets for i in range(1, buckets)]
    cuts = {
        row[key]: sorted(set(row["cuts"]))
        for row in counts.groupBy(key).agg(
            F.percentile_approx(value, grid, 1000).alias("cuts")).collect()
    }
    if not cuts:
        return counts.groupBy(key).agg(*[F.max(value).alias(f"q{i}") for i in range(len(shares))])
    table = F.create_map(*[c for name, points in cuts.items() for c in (F.lit(name), F.lit(points))])
    bucket = F.size(F.filter(table[F.col(key)], lambda cut: cut < F.col(value)))
    cum = running_sums(counts.withColumn("_b", bucket), [key], value, "_b", ["_n"])
    sizes = counts.groupBy(key).agg(F.sum("_n").alias("_size"))
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("_size") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("cum__n") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("cum__n") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(f"q{i}"))
    return cum.join(F.broadcast(sizes), key).groupBy(key).agg(*picks)


def hash_rank(df: DataFrame, keys: Sequence[str], id_col: str, out: str,
              salt: str = "") -> DataFrame:
    """1, 2, 3 ... in the order of the md5 of the id, inside each of a handful of keys."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(salt)))
    marked = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    one = marked.withColumn("_order", F.struct("_h", id_col)).withColumn("_one", F.lit(1))
    cum = running_sums(one, keys, "_order", "_b", ["_one"])
    return cum.withColumn(out, F.col("cum__one")).drop("_h", "_b", "_order", "_one", "cum__one")
