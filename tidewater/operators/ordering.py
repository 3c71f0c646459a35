"""Ranks and running sums over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import skew


def running(rows: DataFrame, value: str, sums: dict[str, str], largest: bool = False) -> DataFrame:
    """``(value, <name>...)``: for each different value, the sums (name to expression) over all rows up to and with it; with ``largest`` the greatest instead.

    Rows are folded to different values first, and these are written, so ties cost one
    row and the input is read once.  Values of any type that has an order are dealt
    to ranges; sums run inside the ranges, and the totals of the ranges before (a row for each) are added.
    """
    spark = rows.sparkSession
    fold = F.max if largest else F.sum
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = durable(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(*[fold(F.expr(e)).alias(n) for n, e in sums.items()]))
    # the numbers of the ranges are written with the rows, as they depend on a sample
    dealt = durable(values.repartitionByRange(ranges, value).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most `ranges` rows
    totals = dealt.groupBy("_part").agg(*[fold(n).alias(n) for n in sums]).select("_part", *[fold(n).over(before).alias(f"_{n}") for n in sums])
    both = lambda own, earlier: F.greatest(own, earlier) if largest else own + F.coalesce(earlier, F.lit(0))
    return dealt.join(F.broadcast(totals), "_part").select(value, *[both(fold(n).over(within), F.col(f"_{n}")).alias(n) for n in sums])


def ranked(rows: DataFrame, value: str, name: str = "place", descending: bool = True) -> DataFrame:
    """``rows`` with the rank of ``value`` among all rows; equal values share the best place, a null has none.

    ``value`` may be of any type that has an order.  Ranks of hot values are sent
    to their rows; only rows of other values are shuffled by value (``skew.lookup``).
    """
    rows = durable(rows)
    upto = running(rows, value, {"_upto": "1"})
    here = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_here"))
    total = rows.filter(F.col(value).isNotNull()).count()
    place = F.lit(total) - F.col("_upto") + 1 if descending else F.col("_upto") - F.col("_here") + 1
    places = durable(upto.join(here, value).select(value, place.cast("long").alias(name)))
    return skew.lookup(rows, places, value)


def group_frames(rows: DataFrame, by: list[str], order: list, preceding: int, following: int, values: dict) -> DataFrame:
    """``rows`` with aggregates (name to expression) over frames of peer groups: those from ``preceding`` before a row's own to ``following`` after.

    Rows with equal ``order`` are one group, as are those with nulls; a negative number moves an end to the other side.
    A frame of groups is a range of the groups' numbers.
    """
    numbered = rows.withColumn("_group", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    frame = Window.partitionBy(*by).orderBy("_group").rangeBetween(-preceding, following)
    return numbered.select(*rows.columns, *[c.over(frame).alias(n) for n, c in values.items()])
