"""Connected components by alternating large-star and small-star steps, with every step a written table. Nodes of many links are no hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("a"), F.max("b")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    return join_hot(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_hot(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of all nodes that edges (a, b) hold, but the least ones."""
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        edges = stage(_small_star(stage(_large_star(edges), "large-star")), "small-star")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
