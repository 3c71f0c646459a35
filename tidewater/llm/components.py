"""Connected components of an edge table, by alternating star contraction.

Large-star then small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) until nothing changes, which they do after a number
of rounds that grows with the logarithm of the nodes.  Each step groups edges by
node with map-side minima and joins the minimum back; nodes of many edges are
joined where their rows are (``join_counted``), so the hub of a star is neither a
collected list nor one task's work.  Rounds are cut by reliable checkpoints; the
driver sees a few numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is its component's smallest node."""
    edges = common.durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, after = None, _signature(edges)
    if not after[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while after != before:
        before = after
        common.release()  # plans of earlier rounds, which hold what they broadcast
        # Large star: each larger neighbour of a node is tied to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = common.durable(common.join_counted(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: each node and its smaller neighbours are tied to the smallest of them.
        least = common.durable(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        tied = common.join_counted(large, least, ["a"])
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = common.durable(small.filter("a <> b").distinct())
        after = _signature(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
