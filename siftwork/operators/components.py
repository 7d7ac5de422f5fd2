"""Connected components of an edge table, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Edge tables up to this many rows keep their minima in the plan; larger ones write them, so that Spark can split the join's hub nodes.
SMALL = 1_000_000


def large_star(pairs: DataFrame, split: bool = False) -> DataFrame:
    """pairs(u, v): every larger neighbour of a node links to the node's smallest neighbour, or to the node itself if that is smaller."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, "least") if split else least
    # An edge gives one row at most, so repeated rows can wait for the small star.
    return stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")


def small_star(pairs: DataFrame, split: bool = False) -> DataFrame:
    """pairs(u, v) with u > v: a node and its smaller neighbours link to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = stored(least, "least") if split else least
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return stored(pairs.join(least, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct(), "small")


def are_stars(pairs: DataFrame) -> bool:
    """Whether of pairs(u, v) with u > v, each once, no node has two smaller neighbours, or a smaller and a larger one."""
    ends = pairs.select("u", F.lit(1).alias("n")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("n")))
    nodes = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return not nodes.where("n > 1 or n = 1 and least = 0").limit(1).count()


def contract(pairs: DataFrame, split: bool = False) -> DataFrame:
    """One round: two large stars and a small one; a chain shrinks to less than half in each."""
    return small_star(large_star(large_star(pairs, split), split), split)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest member) for every node of edges; ids of any type that has an order.

    Every star is a grouped minimum with map-side combine and one join, and is written to the shared folder, so a lost executor costs
    one step.  The rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "edges")
    # Stars are what rounds end with; edges that are stars already, as those of single groups, need none.
    while not are_stars(pairs):
        pairs = contract(pairs, pairs.count() > SMALL)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
