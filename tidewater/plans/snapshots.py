"""Digests of snapshots, links of audit rows, frames of peer groups and shredded variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merkle, ordering
from ..session import shared_folder, table
from ..sources import files, variants
from .evidence import ORACLE as EVIDENCE


def _written(df, key):
    """A snapshot in the shared folder, in the order of its keys, so that a range of them is a part of its files."""
    path = f"{shared_folder(df.sparkSession)}/snapshot_{uuid.uuid4().hex}.parquet"
    files.write(df.repartitionByRange(key).sortWithinPartitions(key), path, "parquet")
    return files.read(df.sparkSession, path, "parquet", df.schema)


def snapshot_merkle(spark, sf_dir):
    """The changes of ``snapshot_diff``, read from the key ranges alone whose digests differ."""
    own = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    after = own.filter("event_id % 11 <> 0").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "edited").otherwise(F.col("event_type")))
    return merkle.diff(_written(own.filter("event_id % 17 <> 0"), "event_id"), _written(after, "event_id"), "event_id", ["event_type", "user_id"], 8)


def audit_chain(spark, sf_dir):
    """Events as linked audit rows, of which some were deleted and some changed afterwards."""
    columns = ["ts", "user_id", "value"]
    own = table(spark, sf_dir, "events").select("event_id", *columns)
    ends = own.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    kept = merkle.linked(own, "event_id", columns).filter("event_id % 97 <> 5")
    kept = kept.withColumn("value", F.when(F.col("event_id") % 101 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return merkle.broken(kept, "event_id", columns, ends.a, ends.b).select(F.col("seq").alias("event_id"), "fault")


def groups_frame(spark, sf_dir):
    """Events of a user by hour of the day, ties and hours that are not known: sums over the two hours that occur before and the one after."""
    hour = F.when(F.hour("ts") % 7 != 3, F.hour("ts"))
    own = table(spark, sf_dir, "events").select("event_id", "user_id", hour.alias("hour"), "value")
    found = ordering.group_frames(own, ["user_id"], [F.col("hour").asc_nulls_first()], 2, 1, {"n": F.count("*"), "total": F.sum("value"), "first": F.min("event_id")})
    return found.select("event_id", "hour", "n", F.round("total", 4).alias("total"), "first")


def variant_shredded(spark, sf_dir):
    """Events' properties as typed columns; some texts are cut off, of another type, without the key or not there."""
    text = F.expr("CASE event_id % 40 WHEN 0 THEN substr(props, 1, 5) WHEN 1 THEN '{\"k\": \"x\"}' WHEN 2 THEN '{}' WHEN 3 THEN NULL ELSE props END")
    own = table(spark, sf_dir, "events").select("event_id", text.alias("props"))
    found = variants.shredded(own, "props", {"k": ("$.k", "bigint")})
    return found.select("event_id", "k", "state")


QUERIES = {f.__name__: f for f in (snapshot_merkle, audit_chain, groups_frame, variant_shredded)}
ORACLE = {
    "snapshot_merkle": EVIDENCE["snapshot_diff"],
    "audit_chain": "WITH k AS (SELECT event_id FROM events WHERE event_id % 97 <> 5), m AS (SELECT min(event_id) AS a, max(event_id) AS b FROM events) SELECT k.event_id, 'tampered' AS fault FROM k WHERE event_id % 101 = 7 UNION ALL SELECT k.event_id, 'deleted' FROM k, m WHERE k.event_id > m.a AND (k.event_id - 1) NOT IN (SELECT event_id FROM k) UNION ALL SELECT b + 1, 'deleted' FROM m WHERE b > (SELECT max(event_id) FROM k)",
    "groups_frame": "WITH e AS (SELECT event_id, user_id, CASE WHEN hour(ts) % 7 <> 3 THEN hour(ts) END::INT AS hour, value FROM events) SELECT event_id, hour, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, min(event_id) OVER w AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY hour NULLS FIRST GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "variant_shredded": "WITH t AS (SELECT event_id, CASE event_id % 40 WHEN 0 THEN substr(props, 1, 5) WHEN 1 THEN '{\"k\": \"x\"}' WHEN 2 THEN '{}' WHEN 3 THEN NULL ELSE props END AS props FROM events), j AS (SELECT event_id, props, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS raw FROM t) SELECT event_id, try_cast(raw AS BIGINT) AS k, CASE WHEN props IS NULL THEN 'none' WHEN NOT json_valid(props) THEN 'malformed' WHEN raw IS NOT NULL AND try_cast(raw AS BIGINT) IS NULL THEN 'misfit' ELSE 'ok' END AS state FROM j",
}
