"""Connected components by alternating stars, on ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataforge.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    Large stars tie every larger neighbour of a node to the node's smallest
    neighbour, small stars do the same with the smaller ones; after a
    logarithmic number of rounds all edges point to the smallest node.  Each round
    is two partial minima and two joins that skewed nodes may split, and is
    written to the shared folder.
    """
    current = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = staged(small, "small-star")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
