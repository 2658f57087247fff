"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), longs; the component is its least node.

    Each step points nodes at the least node they know of; rows shrink to one per node. It ends when
    every node points at one node that points nowhere, which is exactly when the stars are the
    components. The table is checkpointed each round, so a lost executor costs one round at most.
    Minima are pre-aggregated, and joins on a hot node are plain equi-joins that adaptive execution
    can split. Self-loops and repeated edges are ignored; an empty table gives an empty table.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node points at one node only and that one at none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out + met > 1 and out > 0").isEmpty()
