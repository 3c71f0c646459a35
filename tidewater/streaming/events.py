"""Streams over the event table: windows, sessions, static joins, run to completion and read back.

Each run reads what is there (``availableNow``) and writes its complete result
as Parquet into the shared folder, where its checkpoint is too; the rows don't
pass the driver.  Windows run in complete mode, so an event that comes behind the
watermark counts like any other; session windows drop such events even in
this mode, so sessions have no watermark.  Streams that keep rows or keys
(de-duplication, joins, tallies) take the delay that they allow for: what comes later is
dropped, and state older than it is let go.  Over a finite table the queries
allow for its whole span, as its files may come in any order.  Event times are
cast to instants, as watermarks need them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import shared_folder, table
from . import tally


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    # a stream reads folders: the table's own, or the one that its file is in
    return stream.option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parqu[e]t").withColumn("ts", F.col("ts").cast("timestamp"))


def whole_span(spark: SparkSession, sf_dir: str) -> str:
    """A delay that no event of the table exceeds, whatever order its files come in."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    found = table(spark, sf_dir, "events").agg(F.ceil(F.max(seconds) - F.min(seconds)).alias("s")).first().s
    return f"{(found or 0) + 1} seconds"


def complete(result: DataFrame) -> DataFrame:
    """The result of a stream after all that there is to read."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    last: list[str] = []  # each batch writes the result anew, over that of the batch before the last

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path := f"{folder}/rows-{batch % 2}")
        last[:] = [path]

    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(result.schema).parquet(last[0]) if last else spark.createDataFrame([], result.schema)


def _window(bounds: str = "window") -> list:
    return [F.col(f"{bounds}.start").cast("timestamp_ntz").alias("begin"), F.col(f"{bounds}.end").cast("timestamp_ntz").alias("end")]


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = source(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return complete(counted).select(*_window(), "event_type", "n")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = source(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return complete(counted).select(*_window(), "n")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = source(spark, sf_dir).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return complete(counted).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("begin"), "n")


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    counted = source(spark, sf_dir).join(names, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return complete(counted).select("c_mktsegment", "n")


def appended(result: DataFrame) -> DataFrame:
    """The rows of a stream that only ever adds some; the file sink's log makes each batch count once."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    query = result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")


def updated(result: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream that replaces rows; each batch is a folder, and a repeated batch overwrites its own."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/b={batch}")

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    columns = [c for c in result.columns if c not in keys]
    whole = spark.read.schema(StructType([*result.schema.fields]).add("_batch", LongType())).parquet(f"{folder}/rows/*")
    return whole.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_last")).select(*keys, "_last.*")


def deduplicated(events: DataFrame, keys: list[str], delay: str, time: str = "ts") -> DataFrame:
    """One row for each value of ``keys``; a key is remembered for ``delay`` of event time, and rows later than that are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's types of a day once."""
    day = F.date_trunc("day", F.col("ts"))
    own = deduplicated(source(spark, sf_dir).withColumn("day", day), ["user_id", "event_type", "day"], whole_span(spark, sf_dir))
    return appended(own.select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day")))


def stream_stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the same user's purchases within twelve hours after them; both sides forget what no row to come can meet."""
    delay = whole_span(spark, sf_dir)
    own = lambda kind, name: source(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_at")).withWatermark(f"{name}_at", delay)
    views, bought = own("view", "view"), own("purchase", "purchase")
    on = F.expr("view_user = purchase_user AND purchase_at >= view_at AND purchase_at <= view_at + INTERVAL 12 HOURS")
    return appended(views.join(bought, on).select("view_id", "purchase_id"))


def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's number of events, sum of values and longest gap, right for events in any order within the delay."""
    tallies = tally.tallied(source(spark, sf_dir).select("user_id", "ts", "value"), whole_span(spark, sf_dir))
    name, provider = tally.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        return updated(tallies, ["user_id"]).select("user_id", "n", "hundredths", "longest_s")
    finally:
        spark.conf.set(name, before)


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive out of order: the second ten days, then the rest in two parts, then the first ten.

    Those are behind the watermark of eleven days and are dropped; rows are held
    against the watermark of the batch before the last, so two batches raise it first.
    """
    folder = f"{shared_folder(spark)}/late_{uuid.uuid4().hex}"
    day = F.datediff("ts", F.lit("2024-01-01"))
    own = table(spark, sf_dir, "events").select("ts", "event_type")
    for part in (day.between(10, 19), day.between(20, 24), day >= 25, day < 10):
        own.filter(part).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = stream.withWatermark("ts", "11 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return updated(counted.select(F.col("window.start").alias("begin"), "event_type", "n"), ["begin", "event_type"]).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n")


QUERIES = {"stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_session": stream_session, "stream_static_join": stream_static_join, "stream_dedup": stream_dedup, "stream_stream_interval_join": stream_stream_interval_join, "stream_stateful": stream_stateful, "stream_late_drop": stream_late_drop}
ORACLE = {
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS begin, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
    "stream_sliding": "SELECT b AS begin, b + INTERVAL 1 DAY AS \"end\", count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS b FROM events) x GROUP BY b",
    "stream_session": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS begin, count(*)::BIGINT AS n FROM t GROUP BY user_id, k",
    "stream_static_join": "SELECT c_mktsegment, count(*)::BIGINT AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events",
    "stream_stream_interval_join": "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 12 HOUR",
    "stream_stateful": "WITH g AS (SELECT user_id, value, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS hundredths, coalesce(max(gap), 0)::BIGINT AS longest_s FROM g GROUP BY 1",
    "stream_late_drop": "SELECT date_trunc('day', ts)::TIMESTAMP AS begin, event_type, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1, 2",
}
