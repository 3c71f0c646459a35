"""Forecast quality: proper scores, calibration, coverage, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import ordering, skew

CLIP = 1e-15


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return -F.avg(y * F.ln(inside) + (1 - y) * F.ln(1 - inside))


def reliability(forecasts: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Mean forecast and outcome in equal bins of the forecast; a forecast of 1 is in the last bin."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return forecasts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("mean_y"))


def crps(draws: Column, y: Column) -> Column:
    """Continuous ranked probability score of an ensemble (array of draws) in one pass over its sorted draws."""
    m = F.size(draws).cast("double")
    ordered = F.array_sort(draws)
    near = F.aggregate(F.transform(draws, lambda x: F.abs(x - y)), F.lit(0.0), lambda a, b: a + b) / m
    spread = F.aggregate(F.transform(ordered, lambda x, i: (2 * (i + 1) - m - 1) * x), F.lit(0.0), lambda a, b: a + b) / (m * m)
    return near - spread


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts only, whatever the partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def block_bootstrap(blocks: DataFrame, draws: int, seed: int, total: str = "total", n: str = "n") -> DataFrame:
    """``(draw, mean)`` of blocks drawn with replacement; ``blocks`` has ``block`` from 0 on, with sums and counts.

    Whole blocks are drawn, as rows of one block depend on each other; they are
    sums already, so a draw costs as many rows as there are blocks.
    """
    count = blocks.count()
    spark = blocks.sparkSession
    picks = spark.range(draws).select(F.col("id").cast("int").alias("draw")).select("draw", F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))).alias("slot"))
    picks = picks.withColumn("block", F.floor(uniform(F.lit(seed), F.col("draw"), F.col("slot")) * count).cast("int"))
    return picks.join(blocks, "block").groupBy("draw").agg((F.sum(total) / F.sum(n)).alias("mean"))


def holm(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """``tests`` with Holm's step-down adjusted ``p_holm``; a null p has none and doesn't count.

    Equal p-values have one adjusted value, that of the first of them, so tests are folded to different values, whose
    ranks and running greatest steps go by ranges: no order of all tests runs through one task.
    """
    tests = durable(tests)
    known = tests.filter(F.col(p).isNotNull())
    here = known.groupBy(p).agg(F.count(F.lit(1)).alias("_here"))
    m = known.count()
    upto = ordering.running(known, p, {"_upto": "1"}).join(here, p)
    steps = upto.select(p, F.least(F.lit(1.0), F.col(p) * (m - (F.col("_upto") - F.col("_here")))).alias("_step"))
    return skew.lookup(tests, durable(ordering.running(steps, p, {"p_holm": "_step"}, largest=True)), p)
