"""Query of packing over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from .packing import pack

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.documents(spark, sf_dir), vocabulary(), with_ids=False)
    return pieces.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
