"""Query of the toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from . import labelled, toxicity


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.select("doc_id", "text"), model, "score")
    return found.select("doc_id", labelled.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
