"""Connected components of links, by alternating stars, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.session import release, settle


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them (and the node).

    A node's neighbours never meet in one place: their least id is a partial aggregate, and a join
    brings it to each of them, which Spark splits where a node has very many.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if larger:  # neighbours above the node
        moved = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("x"), "m")
    else:  # the node and its neighbours below
        below = both.filter("b < a").join(least, F.col("a") == F.col("node"))
        moved = below.select(F.col("b").alias("x"), "m").unionByName(
            least.select(F.col("node").alias("x"), "m"))
    return moved.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either links to larger nodes only or one link, to a smaller node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
    return nodes.agg(F.max(F.col("centre") + F.col("leaf"))).first()[0] in (None, 1)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, of every node of a link.

    ``edges`` has the columns a and b; order, repeats and loops don't matter.
    """
    state = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state = settle(state)
    while not _are_stars(state):
        large = settle(_stars(state, True))
        small = settle(_stars(large, False))
        release(state, large)
        state = small
    parts = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return parts.unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
