"""Closure of a lineage graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def closure(edges: DataFrame, node: str = "snapshot", parent: str = "upstream") -> DataFrame:
    """``(node, parent, depth)``: all that a snapshot rests on, with the length of the shortest way there.

    Each round joins what the last one found with the edges and writes what is new alone, so
    cycles end; the result is the union of what the rounds wrote.  Both joins are by sorting, so that no round's rows are collected for a
    broadcast.  Rounds are as many as the longest shortest way; the
    driver sees one truth value of each.
    """
    edges = durable(edges.select(F.col(node), F.col(parent)).filter(F.col(node).isNotNull() & F.col(parent).isNotNull()).distinct())
    step = edges.select(F.col(node).alias(parent), F.col(parent).alias("_next"))
    found = [edges.withColumn("depth", F.lit(1))]
    while not found[-1].isEmpty():
        ahead = found[-1].join(step.hint("merge"), parent).select(node, F.col("_next").alias(parent)).distinct()
        known = reduce(DataFrame.unionByName, found).select(node, parent)
        found.append(durable(ahead.join(known.hint("merge"), [node, parent], "left_anti").withColumn("depth", F.lit(len(found) + 1))))
    return reduce(DataFrame.unionByName, found)
