"""Interval joins against a double loop: long and short ranges, hot keys, nulls, repeated rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import intervals, ordering, temporal
from tidewater.plans import evidence

START = datetime.datetime(2024, 1, 1)
FAR = datetime.datetime(2200, 1, 1)


def ranges(rng, n):
    out = []
    for i in range(n):
        a = START + datetime.timedelta(seconds=rng.randrange(86400 * 20))
        b = rng.choice([a, a + datetime.timedelta(microseconds=1), a + datetime.timedelta(seconds=rng.randrange(1, 90)), a + datetime.timedelta(days=rng.randrange(9)), FAR, None, a - datetime.timedelta(1)])
        out.append((rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else a, b, i))
    return out + out[:3]


def meets(x, y):
    low, high = max(x[1] or datetime.datetime.min, y[1] or datetime.datetime.min), min(x[2] or datetime.datetime.max, y[2] or datetime.datetime.max)
    full = [(r[1] or datetime.datetime.min) < (r[2] or datetime.datetime.max) for r in (x, y)]
    return x[0] is not None and x[0] == y[0] and low < high and all(full)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_ranges(spark, seed):
    rng = random.Random(seed)
    a, b = ranges(rng, 50), ranges(rng, 60)
    left = spark.createDataFrame(a, "k long, a timestamp_ntz, b timestamp_ntz, i long")
    right = spark.createDataFrame(b, "k long, c timestamp_ntz, d timestamp_ntz, j long")
    want = sorted((x[3], y[3]) for x in a for y in b if meets(x, y))
    args = (left, right, ["k"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
    assert sorted((r.i, r.j) for r in intervals.overlapping(*args).collect()) == want
    alone = sorted(x[3] for x in a if not any(meets(x, y) for y in b))
    got = intervals.overlapping(*args, how="left")
    assert got.columns == ["k", "a", "b", "i", "c", "d", "j"]
    rows = got.collect()
    assert sorted((r.i, r.j) for r in rows if r.j is not None) == want
    assert sorted(r.i for r in rows if r.j is None) == alone and alone
    assert intervals.overlapping(left.limit(0), *args[1:], how="left").count() == 0
    assert intervals.overlapping(left, right.limit(0), *args[2:], how="left").count() == len(a)


def test_points_and_a_plan_with_buckets(spark):
    rng = random.Random(9)
    b = ranges(rng, 40)
    at = [(rng.choice([1, 2, None, 3]), START + datetime.timedelta(seconds=rng.randrange(86400 * 21)), i) for i in range(80)] + [(1, None, 80), *[(1, r[1], 90) for r in b[:9]]]
    points = spark.createDataFrame(at, "k long, at timestamp_ntz, i long")
    right = spark.createDataFrame(b, "k long, c timestamp_ntz, d timestamp_ntz, j long")
    got = intervals.within(points, right, ["k"], "at", "c", "d")
    want = []
    for k, t, i in at:
        found = [r[3] for r in b if k is not None and t is not None and r[0] == k and (r[1] is None or r[1] <= t) and (r[2] is None or t < r[2])]
        want += [(i, j) for j in found] or [(i, None)]
    assert sorted((r.i, -1 if r.j is None else r.j) for r in got.collect()) == sorted((i, -1 if j is None else j) for i, j in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    for line in plan.splitlines():
        if "Join Inner" in line:
            assert "_bucket" in line and "_at" in line
    with pytest.raises(ValueError):
        intervals._joined(points, right, ["k"], (F.lit(0), F.lit(1)), (F.lit(0), F.lit(1)), "outer")


def test_a_hot_key_is_many_buckets(spark):
    """Ranges of a week of one key: a bucket has a share of the pairs, not all of them."""
    left = spark.range(4000).select(F.lit(1).alias("k"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id"))).alias("at"))
    right = spark.range(24).select(F.lit(1).alias("k"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 7).cast("int"))).alias("c"), "id").withColumn("d", F.col("c") + F.expr("INTERVAL 7 DAYS"))
    side = intervals._side(left, ["k"], intervals._micros(F.col("at")), intervals._micros(F.col("at")) + 1, "left")
    other = intervals._side(right, ["k"], intervals._micros(F.col("c")), intervals._micros(F.col("d")), "right")
    level = other.first()["_level"]
    counts = [r["count"] for r in intervals._buckets(side, [level], "left").filter(F.col("_at") == level).groupBy("_bucket").count().collect()]
    assert len(counts) >= 12 and max(counts) <= 4000 // 8
    found = intervals.within(left, right, ["k"], "at", "c", "d")
    assert found.count() == 4000 and found.filter("id IS NULL").count() == 0


def test_null_keys_know_nothing(spark):
    told = spark.createDataFrame([(None, START, 7), (1, START, 8)], "k long, at timestamp_ntz, v long")
    asked = spark.createDataFrame([(None, START), (1, START), (1, None)], "k long, deadline timestamp_ntz")
    got = temporal.as_of_join(asked, told, "k", "deadline", "at", ["v"])
    assert sorted((str(r.k), str(r.deadline), r.v) for r in got.collect()) == sorted([("None", str(START), None), ("1", str(START), 8), ("1", "None", None)], key=lambda x: x[:2])


def test_as_of_join_reads_each_side_once(spark):
    scans = []
    whole = evidence.asof_latest(spark, "/root/testdata/sf0.001")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    scans += [line for line in plan.splitlines() if "FileScan" in line]
    assert not scans  # the union is written; its own plan has a scan for each side
    both = evidence.observations(spark, "/root/testdata/sf0.001").select("entity").union(evidence.decisions(spark, "/root/testdata/sf0.001").select("entity"))
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


@pytest.mark.parametrize("kind", ["date", "string", "double", "long"])
def test_ranks_of_any_ordered_type(spark, kind):
    rng = random.Random(4)
    make = {"date": lambda k: datetime.date(2024, 1, 1 + k), "string": lambda k: f"v{k:02}é", "double": lambda k: k / 3, "long": lambda k: k - 9}[kind]
    values = [make(rng.randrange(20)) for _ in range(300)] + [make(3)] * 200 + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}").repartition(5)
    for descending in (True, False):
        got = {r.id: r.place for r in ordering.ranked(df, "v", descending=descending).collect()}
        known = [v for v in values if v is not None]
        assert got == {i: None if v is None else 1 + sum(w > v if descending else w < v for w in known) for i, v in enumerate(values)}
    assert ordering.ranked(df.limit(0), "v").count() == 0
