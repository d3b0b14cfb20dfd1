"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node.

    Large star: every node hangs its larger neighbours, itself counted, on its
    smallest; small star: the smaller ones.  Both keep the components and a
    linear number of edges, and a few alternations leave stars.  Neighbour lists
    are never collected; the minimum of a list is an aggregate, written first and
    joined back, so that Spark's skew handling spreads the many edges of a hub.
    Edges with a null end are ignored; an empty table gives an empty result.
    """
    tidy = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rows = edges.count()
    now = cut(tidy.distinct(), rows)
    while not stars_only(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * rows)
        # (larger neighbour, smallest of the centre)
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), 2 * rows)
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.filter(F.col("a") != F.col("b")).distinct(), 2 * rows)
    leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def stars_only(edges: DataFrame) -> bool:
    """No node hangs on two others, or hangs and bears others."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).isEmpty()
