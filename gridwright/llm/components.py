"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import cut, join_to_one


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and isn't its component's least, from edges (a, b) of longs.

    Each step rewrites the edges and keeps the components; the graph becomes stars around the
    least nodes in a number of steps that grows as the logarithm of the largest component.
    Nothing is collected but a count, a checksum and a thousand hubs at most, whose rows are
    joined where they are.
    """
    now = cut(_small_star(cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = cut(_small_star(cut(_large_star(now), "links")), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours, as (greater, lesser)."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionByName(turned).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return join_to_one(turned, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(down: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them. Edges come in and out as (greater, lesser)."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = join_to_one(down, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
