"""Point-in-time operators: what was known when.

An observation has ``entity``, ``observed_at``, ``available_at``, ``revision``
and a value; it is visible at a deadline if ``available_at <= deadline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import intervals


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value_cols: list[str], tie_cols: list[str] = (), bucket: str = "day") -> DataFrame:
    """``left`` with the ``value_cols`` of the last row of ``right`` at or before its time, null without one, and for a null key or time.

    Both sides are united, and the union is written once, so each is read once.  It is
    swept in time order within a key's ``bucket`` of time; at equal times a row of
    ``right`` is visible, and of several the greatest by ``tie_cols``.  So a hot key is as many tasks as it
    has buckets, and what was known when a bucket began is carried over from the ends of the
    earlier ones, a row for each key and bucket.
    """
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie_cols)]
    tie_names = [f"_tie{i}" for i in range(len(tie_cols))]
    told = right.filter(F.col(right_time).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), *ties, F.struct(*value_cols).alias("_known"))
    asked = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = durable(told.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, F.col("_at"))))
    ends = both.groupBy("_by", "_bucket").agg(F.max_by("_known", F.when(F.col("_side") == 0, F.struct("_at", *tie_names))).alias("_end"))
    earlier = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_by").alias("_key"), F.col("_bucket").alias("_own"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    sweep = Window.partitionBy("_by", "_bucket").orderBy("_at", "_side", *tie_names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_last", F.last("_known", ignorenulls=True).over(sweep)).filter("_side = 1")
    found = swept.join(carried, (F.col("_by") == F.col("_key")) & (F.col("_bucket") == F.col("_own")), "left").select("_row", F.coalesce("_last", "_carried").alias("_last"))
    return found.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in value_cols])


def running_before(rows: DataFrame, by: str, time: str, order: list[str], sums: dict[str, Column], bucket: str = "day") -> DataFrame:
    """``rows`` with sums (name to numeric expression) over all earlier rows of their key in the order of ``time`` and ``order``; 0 before any.

    A key's buckets of time are summed side by side, as in ``as_of_join``; what came
    before a bucket is added from the sums of the earlier ones.
    """
    dealt = rows.withColumn("_bucket", F.date_trunc(bucket, F.col(time)))
    ends = dealt.groupBy(by, "_bucket").agg(F.struct(*[F.sum(c).alias(n) for n, c in sums.items()]).alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(by).alias("_key"), F.col("_bucket").alias("_own"), *[F.sum(f"_end.{n}").over(earlier).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy(by, "_bucket").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumns({f"_within_{n}": F.sum(c).over(within) for n, c in sums.items()})
    found = found.join(carried, found[by].eqNullSafe(F.col("_key")) & found["_bucket"].eqNullSafe(F.col("_own")))
    zero = F.lit(0)
    return found.select(*rows.columns, *[(F.coalesce(f"_within_{n}", zero) + F.coalesce(f"_before_{n}", zero)).alias(n) for n in sums])


def visible(observations: DataFrame, deadline: Column, embargo_hours: int = 0) -> Column:
    """Whether an observation may be used at ``deadline`` under a publication embargo."""
    return observations["available_at"] + F.expr(f"INTERVAL {int(embargo_hours)} HOURS") <= deadline


def latest_revision(observations: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Of each key the revision known at ``at``: the last available, then the highest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("available_at"), F.desc("revision"))
    return observations.filter(F.col("available_at") <= at).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def fold_bounds(spark, first: str, days: int, count: int, expanding: bool, embargo_days: int = 0) -> DataFrame:
    """``(fold, train_from, train_to, test_from, test_to)``: half-open windows whose test part follows the training part and the embargo."""
    start = F.to_timestamp_ntz(F.lit(first))
    step = lambda k: F.make_dt_interval(k * days)
    k = F.col("fold")
    return spark.range(1, max(count, 0) + 1).select(F.col("id").cast("int").alias("fold")).select(
        "fold",
        (start if expanding else start + step(k - 1)).alias("train_from"),
        (start + step(k) - F.make_dt_interval(F.lit(embargo_days))).alias("train_to"),
        (start + step(k)).alias("test_from"),
        (start + step(k + 1)).alias("test_to"),
    )


def in_folds(rows: DataFrame, folds: DataFrame, time_col: str) -> DataFrame:
    """Each row with each fold it belongs to and its part; folds are a handful, so they are sent to the rows."""
    at = rows[time_col]
    train = (at >= folds["train_from"]) & (at < folds["train_to"])
    test = (at >= folds["test_from"]) & (at < folds["test_to"])
    return rows.join(F.broadcast(folds), train | test).withColumn("part", F.when(test, "test").otherwise("train")).drop("train_from", "train_to", "test_from", "test_to")


def standardise_in_folds(rows: DataFrame, value_col: str) -> DataFrame:
    """Scores of ``rows`` (with fold and part) by the mean and deviation of their fold's training part alone."""
    fitted = rows.filter("part = 'train'").groupBy("fold").agg(F.avg(value_col).alias("_mean"), F.stddev_samp(value_col).alias("_sd"))
    return rows.join(F.broadcast(fitted), "fold").withColumn("z", (F.col(value_col) - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that were added, removed or silently changed between two snapshots."""
    digest = lambda: F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))
    a, b = before.select(key, digest().alias("old")), after.select(key, digest().alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def valid_at(rows: DataFrame, ids: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """``rows`` with the columns of ``ids`` whose half-open range (``valid_from``, ``valid_to``) holds the row's time, null without one.

    An interval join on keys and buckets of time; a row for which several ranges are valid is there once for each.
    """
    return intervals.within(rows, ids, keys, time_col, "valid_from", "valid_to")


def nested_bounds(spark, first: str, days: int, count: int) -> DataFrame:
    """``(outer, inner, valid_from, valid_to)``: the inner folds before the test part of each outer fold from the second on; they train on all that is before their validation."""
    start = F.to_timestamp_ntz(F.lit(first))
    folds = spark.range(2, max(count, 1) + 1).select(F.col("id").cast("int").alias("outer")).select("outer", F.explode(F.sequence(F.lit(1), F.col("outer") - 1)).alias("inner"))
    return folds.select("outer", "inner", (start + F.make_dt_interval(F.col("inner") * days)).alias("valid_from"), (start + F.make_dt_interval((F.col("inner") + 1) * days)).alias("valid_to"))
