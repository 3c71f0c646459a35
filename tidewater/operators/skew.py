"""Joins whose hot keys stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; there are fewer of them than this.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once; null keys find nothing.

    The table's rows of hot keys, fewer than ``HOT_SHARE`` of them, are sent to where those
    keys' rows are; only rows of other keys are shuffled.  Both inputs should be
    written ones, as they are read more than once; the table's rows are to be small.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = counts.filter((F.col("_n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key)
    added = [c for c in table.columns if c != key]
    held = table.select(F.col(key).alias("_key"), *added)
    near = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    sent = held.join(F.broadcast(hot.select(F.col(key).alias("_hot_key"))), F.col("_key") == F.col("_hot_key"), "left_semi")
    on = F.col(key) == F.col("_key")
    a = near.filter("_hot").select(*rows.columns).join(F.broadcast(sent), on, how)
    b = near.filter("_hot IS NULL").select(*rows.columns).join(held, on, how)
    return a.unionByName(b).select(*rows.columns, *added)
