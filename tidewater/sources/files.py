"""Tables as CSV, JSON lines, ORC, text and Parquet files, always by a stated schema.

Nothing is inferred.  Rows of a text format that don't fit their schema are kept:
``read_checked`` gives them apart, with their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: What makes a value the same after writing and reading.
OPTIONS = {
    "csv": {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "multiLine": "true", "lineSep": "\n"},
    "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "orc": {"compression": "zstd"},
    "parquet": {"compression": "zstd"},
}
BAD = "_corrupt_record"


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    df.write.format(kind).options(**OPTIONS[kind]).partitionBy(*(partition_by or [])).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """Fails on a row that doesn't fit."""
    checked = {"mode": "FAILFAST"} if kind in ("csv", "json") else {}
    return spark.read.schema(schema).format(kind).options(**OPTIONS[kind], **checked).load(path)


def read_checked(spark: SparkSession, path: str, kind: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and those that don't with their text in the last column, ``BAD``, beside what could be read of them."""
    whole = spark.read.schema(StructType([*schema.fields]).add(BAD, StringType())).format(kind).options(**OPTIONS[kind], mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).load(path)
    return whole.filter(F.col(BAD).isNull()).drop(BAD), whole.filter(F.col(BAD).isNotNull())
