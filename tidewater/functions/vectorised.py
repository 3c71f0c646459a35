"""One function of each kind: scalar, grouped aggregate, per batch, per group, per pair of groups, and a table function."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType


@F.pandas_udf(DoubleType())
def soft_cap(value: pd.Series, cap: pd.Series) -> pd.Series:
    """Values up to the cap as they are, above it their excess on a logarithmic scale."""
    import numpy as np

    over = (value - cap).clip(lower=0)
    return value.where(value <= cap, cap + np.log1p(over))


@F.pandas_udf(DoubleType())
def geometric_mean(value: pd.Series) -> float:
    import numpy as np

    value = value.dropna()
    return float(np.exp(np.log(value).mean())) if len(value) else float("nan")


def with_checksum(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the sum of a text's code points, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["checksum"] = [None if t is None else sum(map(ord, t)) for t in frame[column]]
            yield frame.astype({"checksum": "Int64"})

    return df.mapInPandas(run, StructType([*df.schema.fields]).add("checksum", LongType()))


def trend(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of each group; the sums are taken per group and partition first, so a group of any size is a few numbers."""
    parts = df.groupBy(by, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")).drop("_part")

    def slope(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s = frame[["n", "sx", "sy", "sxx", "sxy"]].sum()
        down = s.n * s.sxx - s.sx * s.sx
        return pd.DataFrame({by: [key[0]], "slope": [None if down == 0 else (s.n * s.sxy - s.sx * s.sy) / down], "n": [int(s.n)]})

    return parts.groupBy(by).applyInPandas(slope, f"{by} long, slope double, n long")


#: Rows that a pair of groups of ``last_before`` has, about.
BUCKET_ROWS = 20_000


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` before each time, by merging sorted pairs of groups.

    Keys are dealt to as many buckets as keep them at about ``bucket_rows`` rows, and a pair of buckets is merged at once
    within its keys, as a call for each key costs far more than the key's few rows.  Both sides of a key
    are in one task; ``by`` should name groups of bounded size, such as a user's day.
    ``temporal.as_of_join`` needs no such bound.  A row with a null key or time has nothing before it.  Of values at
    one time the largest is taken.
    """
    known = [F.col(c).isNotNull() for c in (*by, at)]
    usable = reduce(Column.__and__, known)
    buckets = (left.count() + right.count()) // bucket_rows + 1

    def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return a[["id"]].assign(value=float("nan"))
        b = b[[*by, at, "value"]].sort_values([at, "value"], na_position="first", kind="stable")
        out = pd.merge_asof(a.sort_values([at, "id"]), b, on=at, by=by, allow_exact_matches=False)
        return out[["id", "value"]]

    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket")
    asked = left.filter(usable).select(bucket, "id", *by, at)
    # columns of the same origin on both sides lose one of them to pruning; a marked alias keeps them apart
    told = right.filter(usable).select(bucket, *[F.col(c).alias(c, metadata={"side": "right"}) for c in (*by, at, "value")])
    found = asked.groupBy("_bucket").cogroup(told.groupBy("_bucket")).applyInPandas(merge, "id long, value double")
    return found.unionByName(left.filter(~usable).select("id", F.lit(None).cast("double").alias("value")))


@F.udtf(returnType=StructType().add("place", IntegerType()).add("word", StringType()))
class SplitWords:
    """The words of a text with their places."""

    def eval(self, text: str | None):
        for k, word in enumerate((text or "").split()):
            yield k, word
