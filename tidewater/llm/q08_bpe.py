"""Query of the BPE operator over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from .bpe import encode

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(common.documents(spark, sf_dir), vocabulary(), with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op8_bpe": op8_bpe}
