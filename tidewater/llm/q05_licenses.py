"""Query of the licence scan of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from . import licenses


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("licenses.base_labels", ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"),
        "licenses.score",
    )


QUERIES = {"op5_licenses": op5_licenses}
