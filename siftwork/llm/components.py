"""Connected components of an edge table, without moving links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest member) for every node of edges; alternates large-star and small-star steps.

    Each step keeps a tree edge (node, smaller node); every step is a grouped
    minimum with map-side combine and one join, and is written to the shared
    folder, so lost executors cost one step at most.  The minima are written
    too: a join of two plain tables is one whose hub nodes Spark can split.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "cc")
    while True:
        # Large star: every larger neighbour of a node links to the node's smallest neighbour or itself.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        # Small star: a node's smaller neighbours and itself link to the smallest of them.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = materialize(small, "cc")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (pairs, after)]
        if sums[0] == sums[1]:
            break
        pairs = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
