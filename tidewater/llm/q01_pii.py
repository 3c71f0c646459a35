"""Query of the personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from . import pii


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[f"pii.n_{k}" for k in pii.BASE_KINDS], "pii.base_sha256", F.array_join("pii.spans", ",").alias("spans"))


QUERIES = {"op1_pii": op1_pii}
