"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import durable, written
from . import skew

#: Links that are few enough for one task.
FEW = 20_000


def few(links: DataFrame) -> DataFrame:
    """``(node, to)`` for each node of few ``links`` (a, b): ``to`` is one node for all that are connected, found in one task."""
    kind = links.schema["a"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict = {}

        def end(x):
            while (up := to.setdefault(x, x)) != x:
                to[x] = x = to[up]
            return x

        own = None
        for batch in batches:
            own = batch.schema.types[0]
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to[end(a)] = end(b)
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(list(to), own), pa.array([end(x) for x in list(to)], own)], names=["node", "to"])

    return links.coalesce(1).mapInArrow(run, StructType([StructField("node", kind), StructField("to", kind)]))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node that has a link: ``component`` is the smallest node that it is connected with.

    In each round a node goes to that of itself and its neighbours which comes first in an
    order that is shuffled anew in each round, so that the number of nodes falls by a share of them,
    whatever the shape; links between what is left go on, until one task connects the last ``FEW``.  Rounds are a few for each doubling of the nodes;
    the driver sees one number of each, and lineage is cut by checkpoints.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    steps: list[DataFrame] = []
    while (left_over := edges.count()) > FEW:
        place = lambda c: F.xxhash64(F.lit(len(steps)), F.col(c))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        first = both.groupBy("node").agg(F.min(F.struct(place("to").alias("place"), F.col("to"))).alias("first"))
        own = F.struct(place("node").alias("place"), F.col("node").alias("to"))
        moved = durable(first.select("node", F.least("first", own)["to"].alias("to")))
        steps.append(moved)
        left = skew.lookup(durable(skew.lookup(edges.toDF("node", "b"), moved, "node").select(F.col("to").alias("a"), F.col("b").alias("node"))), moved, "node")
        edges = written(left.select("a", F.col("to").alias("b")).filter("a <> b").distinct())
    if left_over:
        steps.append(durable(few(edges)))
    if not steps:
        kind = links.schema[a].dataType
        return links.select(F.col(a).cast(kind).alias("node"), F.col(a).cast(kind).alias("component")).limit(0)
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):  # a node goes where the one that it went to goes
        later = found.toDF("to", "_root")
        found = durable(skew.lookup(step, durable(later), "to").select("node", F.coalesce("_root", "to").alias("root")))
    found = durable(found)
    smallest = durable(found.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component")))
    return skew.lookup(found, smallest, "root").select("node", "component")
