"""Connected components of large graphs, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Does every edge (a, b) lead from a leaf to the centre of a star?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e"))
    ends = ends.select("e.node", "e.out").groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return ends.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on the edges (a, b), two longs; a
    component is named after its smallest node.

    Alternates large-star and small-star steps until the edges are stars around
    smallest nodes.  A step is two aggregates and joins by node, its result is a
    table in the shared folder, and nothing but a yes or no reaches the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour of a node now points to the smallest of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # and every smaller one, with the node itself
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e = materialize(small)
        if _are_stars(e):
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
