"""Streams over more files than one batch reads, and where their results are."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewater.streaming import events, tally

START = datetime.datetime(2024, 1, 1)


def table(spark, tmp_path, files=40):
    rng = random.Random(5)
    rows = [(START + datetime.timedelta(seconds=rng.randrange(86400 * 60)), rng.randrange(8), rng.choice(["view", "purchase"])) for _ in range(400)]
    rng.shuffle(rows)  # most events are far behind the watermark of those before
    whole = [(k, *row, float(k % 7)) for k, row in enumerate(rows)]
    spark.createDataFrame(whole, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(u, f"s{u % 3}") for u in range(6)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    return rows


def sessions(rows):
    out, last = {}, {}
    for ts, user, _ in sorted(rows):
        if user not in last or ts - last[user][1] >= datetime.timedelta(hours=6):
            last[user] = (ts, ts)
        last[user] = (last[user][0], ts)
        out[user, last[user][0]] = out.get((user, last[user][0]), 0) + 1
    return out


def test_all_batches_count_and_results_are_files(spark, tmp_path):
    rows = table(spark, tmp_path)
    found = {name: events.QUERIES[name](spark, str(tmp_path)) for name in ("stream_session", "stream_tumbling", "stream_sliding", "stream_static_join")}
    for name, got in found.items():
        assert got.inputFiles() and all(f.endswith(".parquet") for f in got.inputFiles()), name
    assert {(r.user_id, r.begin): r.n for r in found["stream_session"].collect()} == sessions(rows)
    day = lambda ts: ts.replace(hour=0, minute=0, second=0)
    assert {(r.begin, r.event_type): r.n for r in found["stream_tumbling"].collect()} == Counter((day(ts), kind) for ts, _, kind in rows)
    half = datetime.timedelta(hours=12)
    begins = [ts.replace(hour=ts.hour // 12 * 12, minute=0, second=0) for ts, _, _ in rows]
    assert {r.begin: r.n for r in found["stream_sliding"].collect()} == Counter([*begins, *(b - half for b in begins)])
    assert {r.c_mktsegment: r.n for r in found["stream_static_join"].collect()} == Counter(f"s{u % 3}" for _, u, _ in rows if u < 6)


def test_streams_run_without_a_limit():
    assert not hasattr(events, "LIMIT_S")


def test_state_lasts_over_batches(spark, tmp_path):
    """Forty shuffled files: every column equals the batch statement's."""
    import duckdb

    table(spark, tmp_path)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("stream_stateful", "stream_dedup", "stream_stream_interval_join"):
        want = con.execute(events.ORACLE[name])
        names = [d[0] for d in want.description]
        got = events.QUERIES[name](spark, str(tmp_path)).select(names).collect()
        assert got and sorted(map(tuple, got)) == sorted(want.fetchall()), name
    assert spark.conf.get(store) == before


def test_tally_closes_days_and_drops_what_is_late(spark, tmp_path):
    """With a delay of two days, days behind it are closed in order; an event from before is dropped."""
    day = lambda d, s=0: START + datetime.timedelta(days=d, seconds=s)
    files = [[(1, day(0, 50), 1.0), (1, day(0, 10), 2.0)], [(1, day(3), 1.0), (2, day(1), 1.0)], [(1, day(9, 5), 0.5)], [(1, day(8, 5), 0.25), (1, day(8, 5), 0.25)], [(1, day(1), 100.0)], [(1, day(9, 5), 0.0)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/own")
        if k == 0:
            schema = spark.read.parquet(f"{tmp_path}/own").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/own").withColumn("ts", F.col("ts").cast("timestamp"))
    name, provider = tally.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        got = {r.user_id: (r.n, r.hundredths, r.longest_s) for r in events.updated(tally.tallied(stream, "2 days"), ["user_id"]).collect()}
    finally:
        spark.conf.set(name, before)
    assert got[2] == (1, 100, 0)
    assert got[1] == (7, 500, 5 * 86400 + 5)


def test_longest_gap():
    assert tally.longest_gap([], None, 0) == (None, 0)
    assert tally.longest_gap([5, 9, 30], None, 0) == (30, 21)
    assert tally.longest_gap([50, 51], 20, 3) == (51, 30)
