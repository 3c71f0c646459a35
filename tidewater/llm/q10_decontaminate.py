"""Query of benchmark decontamination over all documents and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as common
from .decontaminate import overlaps


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_GRAM = "array_to_string(ws[i:i + n - 1], ' ')"
ORACLE = {
    "op10_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
      b AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) x WHERE len(ws) > 0),
      w AS (SELECT DISTINCT item_id, n, {_GRAM} AS gram FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM b) x),
      g AS (SELECT doc_id, n, i, {_GRAM} AS gram FROM (SELECT doc_id, ws, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM w) s ON len(ws) >= s.n) x),
      h AS (SELECT doc_id, i, g.n, item_id FROM g JOIN w ON w.n = g.n AND w.gram = g.gram),
      k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) x GROUP BY 1),
      t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) x GROUP BY 1)
      SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
}
