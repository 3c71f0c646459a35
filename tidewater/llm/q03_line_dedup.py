"""Query of the repeated runs of lines in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from . import line_dedup


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = line_dedup.marked(docs)
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    lines = F.filter(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), lambda i: F.exists("runs", lambda r: (r.first <= i) & (i <= r.last)))
    removed = F.when(F.col("runs").isNotNull(), lines).otherwise(F.array().cast("array<int>"))
    return found.select(
        "doc_id",
        n_lines.alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(line_dedup.kept_lines(text, F.col("runs")).cast("binary"), 256).alias("text_sha256"),
    )


QUERIES = {"op3_line_dedup": op3_line_dedup}
