"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import _common as common

#: Most labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 6000
#: Most characters of their texts.
SAMPLE_CHARS = 32_000_000


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(id_col, modulus) == value, F.lit(False))


def known(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(id, label)`` of all labels 0 and 1 that are not held out, and ``(id, text)`` of all documents that may have one.

    No text is shuffled: the documents are told by ``common.suspects``, and more of them than are labelled may be left.
    """
    kind = dict(docs.dtypes)[id_col]
    own = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col, modulus, value))
    own = common.durable(own.select(F.col(id_col).try_cast(kind).alias("id"), F.col(label).cast("int").alias("label")).filter("id IS NOT NULL"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    may, _ = common.suspects(texts, F.xxhash64("id"), own.select(F.xxhash64("id").alias("h")))
    return own, may


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most ``rows`` labelled rows that are not held out, and of at most ``chars`` characters in all.

    Rows are taken whole, in the order of their ids' hashes; of repeated rows
    each counts.  The chosen ids (bounded by ``rows``) are sent to the one scan of
    the texts, and the rows found are written to the shared folder; of these the
    bounded sample is taken by ids, labels and lengths.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col, modulus, value)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    marked = common.durable(texts.join(F.broadcast(chosen), "_id").withColumn("_key", F.xxhash64("_text")))
    sizes = marked.select("_id", "_label", "_key", F.length("_text").alias("_n"), F.xxhash64("_id").alias("_order")).orderBy("_order", "_id", "_label", "_key").limit(rows + 1).collect()
    taken, total = Counter(), 0
    for r in sizes[:rows]:
        if total + r._n > chars:  # a text that doesn't fit leaves room for the others
            continue
        total += r._n
        taken[r._id, r._label, r._key] += 1
    if not taken:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(*key, n) for key, n in taken.items()], marked.select("_id", "_label", "_key").schema.add("_times", IntegerType()))
    found = marked.join(F.broadcast(wanted), ["_id", "_label", "_key"])
    if len(sizes) > rows:  # some row may be repeated more often than it is wanted
        found = found.groupBy("_id", "_label", "_text").agg(F.first("_times").alias("_times"))
    else:
        found = found.withColumn("_times", F.lit(1))
    found = found.select("_id", "_label", "_text", "_times").collect()
    out = sorted((r._id, r._text, r._label) for r in found for _ in range(r._times))
    return [t for _, t, _ in out], [y for _, _, y in out]
