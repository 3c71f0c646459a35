"""Merges of pairs of groups against a plain search."""

import datetime as dt
import random

from tidewater.functions import vectorised


def test_last_before_in_buckets_equals_a_plain_search(spark):
    rng = random.Random(5)
    at = lambda: None if rng.random() < 0.03 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(40))
    key = lambda: (None if rng.random() < 0.03 else rng.randrange(12), rng.choice(["a", "b", None, "c"]))
    left = [(i, *key(), at()) for i in range(300)]
    right = [(*key(), at(), float(i)) for i in range(400)]
    asked = spark.createDataFrame(left, "id long, k long, s string, ts timestamp_ntz")
    told = spark.createDataFrame(right, "k long, s string, ts timestamp_ntz, value double")

    def plain(k, s, t):
        if None in (k, s, t):
            return None
        before = [(u, v) for rk, rs, u, v in right if (rk, rs) == (k, s) and u is not None and u < t]
        return max(before)[1] if before else None

    want = {i: plain(k, s, t) for i, k, s, t in left}
    for rows in (20_000, 100, 1):
        got = vectorised.last_before(asked, told, ["k", "s"], "ts", rows).collect()
        assert len(got) == 300 and {r.id: r.value for r in got} == want
    for empty in (asked.limit(0), asked):
        got = vectorised.last_before(empty, told.limit(0), ["k", "s"], "ts").collect()
        assert [r.value for r in got] == [None] * empty.count()


def test_keys_share_merges(spark):
    """A call for each key took a minute for 20,000 keys; keys are merged by the bucket."""
    own = spark.range(6000).selectExpr("id", "id AS k", "timestamp_ntz'2024-01-02' AS ts")
    told = own.selectExpr("k", "timestamp_ntz'2024-01-01' AS ts", "CAST(id AS double) AS value")
    found = vectorised.last_before(own, told, ["k"], "ts")
    assert {r.id: r.value for r in found.collect()} == {i: float(i) for i in range(6000)}
    assert found.rdd.getNumPartitions() <= 8 and "_bucket" in found._jdf.queryExecution().toString()
