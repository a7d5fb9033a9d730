"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation (min of the neighbours, combined map-side) and a join on the node, which adaptive execution
can split where one node holds many edges.  Edges stay in the cluster; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    to_low = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v); root: the smallest node of its component, itself included."""
    mark = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := tuple(mark(edges))) != before:
        before = now
        edges = materialize(_small_star(_large_star(edges)))
    roots = edges.select(F.col("u"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
