"""Connected components of a graph given as edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes that have an edge.

    ``edges`` has two long columns u, v; direction, repeats and loops don't matter, nulls are dropped.
    No edges: no rows. Every step aggregates minima and joins them back to the edges, so a node with
    many neighbours is one row on one side and can be split on the other. Steps are written to the
    shared folder, and go on until none changes an edge.
    """
    edges = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while (now := _mark(edges)) != seen:
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        # Small star: a node and its lower neighbours go to the least of them; u > v holds in all edges.
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops.select("node", F.col("node").alias("label")))
