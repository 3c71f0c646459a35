"""From raw documents to token ids: five stages over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.  All but the last return
the columns of ``documents``.

A null text is an empty one and stays, as one of the group of empty texts.  Of
rows with equal ids and texts the near copies' stage leaves one, of rows with one
id and unlike texts all; rows without an id stay, and have no labels.  Very long
texts are whole in each stage.  An empty table gives no rows.  Further columns go along to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import _common as common
from tidewater.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from tidewater.llm.q08_bpe import vocabulary


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after a text was cut."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.dedupe_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digest of what they decode to."""
    return bpe.encode(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

#: A trained model, XXH64 and a tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
        common.release()
    return STAGES[-1][1](spark, docs, sf_dir)
