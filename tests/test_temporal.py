"""Sweeps in buckets of time against plain loops: hot keys, ties, nulls."""

import datetime
import random

from pyspark.sql import functions as F

from tidewater.operators import temporal

START = datetime.datetime(2024, 1, 1)


def rows(rng, n):
    return [(rng.choice([1, 1, 1, 2, None]), START + datetime.timedelta(hours=rng.randrange(24 * 9)), rng.randrange(3), k) for k in range(n)]


def test_as_of_join(spark):
    rng = random.Random(1)
    told, asked = rows(rng, 60), [*rows(rng, 60), (1, None, 0, 99), (7, START, 0, 98)]
    right = spark.createDataFrame(told, "k long, at timestamp_ntz, rev int, value long")
    left = spark.createDataFrame([(k, at, i) for k, at, _, i in asked], "k long, deadline timestamp_ntz, id long")
    for bucket in ("day", "month", "hour"):
        got = {r.id: r.value for r in temporal.as_of_join(left, right, "k", "deadline", "at", ["value"], ["rev", "value"], bucket).collect()}
        want = {}
        for key, deadline, _, i in asked:
            seen = [(at, rev, v) for k, at, rev, v in told if k == key and deadline is not None and at <= deadline and key is not None]
            want[i] = max(seen)[2] if seen else None
        assert {i: v for i, v in got.items() if dict((a[3], a[0]) for a in asked)[i] is not None} == {i: v for i, v in want.items() if dict((a[3], a[0]) for a in asked)[i] is not None}
        assert len(got) == len(asked)


def test_running_before(spark):
    rng = random.Random(2)
    own = [r for r in rows(rng, 80)]
    df = spark.createDataFrame(own, "k long, at timestamp_ntz, rev int, id long")
    got = {r.id: (r.n, r.total) for r in temporal.running_before(df, "k", "at", ["id"], {"n": F.lit(1), "total": F.col("rev")}).collect()}
    for k, at, _, i in own:
        before = [r for r in own if r[0] == k and (r[1], r[3]) < (at, i)]
        assert got[i] == (len(before), sum(r[2] for r in before))
    assert temporal.running_before(df.limit(0), "k", "at", ["id"], {"n": F.lit(1)}).count() == 0


def test_valid_at(spark):
    ids = spark.createDataFrame([(1, 10, START, START + datetime.timedelta(1)), (1, 11, START + datetime.timedelta(1), START + datetime.timedelta(2))], "k long, code long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    own = spark.createDataFrame([(1, START), (1, START + datetime.timedelta(1)), (1, START + datetime.timedelta(2)), (2, START), (None, START)], "k long, at timestamp_ntz")
    got = temporal.valid_at(own, ids, ["k"], "at")
    assert got.columns == ["k", "at", "code", "valid_from", "valid_to"]
    assert sorted((str(r.k), r.at, r.code) for r in got.collect()) == sorted([("1", START, 10), ("1", START + datetime.timedelta(1), 11), ("1", START + datetime.timedelta(2), None), ("2", START, None), ("None", START, None)], key=lambda x: (x[0], x[1]))
