"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in links (a, b); component is the least node that its links reach.

    Each step points nodes to the least node in their neighbourhood; links stay as many as nodes at most, and a hub's
    neighbours are only aggregated to their minimum and joined back, never gathered."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _stars(edges):
        # Large star: each larger neighbour of a node is linked to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node's smaller neighbours and itself are linked to the least of them.
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (u, v), v < u, are stars around their least nodes: no u has two v, none is itself a v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()
