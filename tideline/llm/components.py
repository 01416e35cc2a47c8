"""Connected components of edges by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b): rows (node, component) for every node of an edge, component being the smallest node within reach.

    A large-star step links every larger neighbour of a node to the smallest of its neighbourhood, a small-star step links
    the smaller ones and the node itself to the smallest. Paths halve, so that rounds grow with the logarithm
    of the longest path; each writes its edges, which never grow in number, to the shared folder."""
    now = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = scratch.cut(small.filter("a <> b").distinct())
        # stars: unchanged in number and in the sum of a hash of the edges
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
