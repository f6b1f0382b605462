"""Connected components of a link table, with no collection to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step
    needs a minimum per node, combined before the shuffle, and a join back, so a
    node with very many links is no group that one task must hold.  Every round is
    written to the shared folder; there are as many as it takes (some log n).
    """
    edges = C.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        # large star: every larger neighbour is linked to the least one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = C.stored(large)
        # small star: all smaller neighbours and the node itself are linked to the least
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = C.stored(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
