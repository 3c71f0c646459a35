"""Tables written in another format into the shared folder and read again: nothing may change."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, table
from ..sources import files

CASES = {"csv_round_trip": ("csv", "part"), "json_round_trip": ("json", "events"), "orc_round_trip": ("orc", "orders")}


def round_trip(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}.{kind}"
    own = table(spark, sf_dir, name)
    files.write(own, path, kind)
    return files.read(spark, path, kind, own.schema)


def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in folders; a filter on the type opens the files of its folder alone."""
    path = f"{shared_folder(spark)}/events_{uuid.uuid4().hex}.parquet"
    own = table(spark, sf_dir, "events")
    files.write(own.repartition("event_type"), path, "parquet", ["event_type"])
    return files.read(spark, path, "parquet", own.schema).filter("event_type = 'error'").select("event_id", "user_id", "value")


QUERIES = {name: partial(round_trip, kind=kind, name=of) for name, (kind, of) in CASES.items()} | {"partitioned_scan": partitioned_scan}
ORACLE = {name: f"SELECT * FROM {of}" for name, (_, of) in CASES.items()} | {"partitioned_scan": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'"}
