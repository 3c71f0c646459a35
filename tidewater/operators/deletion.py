"""Whether a deletion reached every zone, seen from what the zones hold now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effect(zones: dict[str, tuple[DataFrame, DataFrame]], listed: DataFrame, key: str) -> DataFrame:
    """``(zone, before, after, left_over, lost)`` for zones as (rows before, rows now): rows now of listed keys, and rows of unlisted ones that went too.

    ``listed`` has the keys to delete (``key``); null keys in a zone are not listed.
    """
    marked = listed.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_listed", F.lit(1))
    out = []
    for zone, (before, now) in zones.items():
        both = before.select(key, F.lit(1).alias("_old")).unionByName(now.select(key, F.lit(0).alias("_old")))
        sums = both.groupBy(key).agg(F.sum("_old").alias("b"), F.sum(1 - F.col("_old")).alias("n"))  # hot keys are one row each from here
        held = sums.join(marked, key, "left")
        is_listed = F.col("_listed").isNotNull()
        found = held.agg(
            F.coalesce(F.sum("b"), F.lit(0)).alias("before"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("after"),
            F.coalesce(F.sum(F.when(is_listed, F.col("n"))), F.lit(0)).alias("left_over"),
            F.coalesce(F.sum(F.when(~is_listed, F.col("b") - F.col("n"))), F.lit(0)).alias("lost"),
        )
        out.append(found.select(F.lit(zone).alias("zone"), "before", "after", "left_over", "lost"))
    return reduce(DataFrame.unionByName, out)
