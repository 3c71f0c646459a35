"""Query of the quality ranking of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from . import labelled, ranking


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    ranks = ranking.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = ranking.score(docs.select("doc_id", "text"), ranks, "score")
    return found.select("doc_id", labelled.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= ranking.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_ranking": op7_quality_ranking}
