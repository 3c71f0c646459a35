"""Query of the filter interaction audit over all documents, and its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _common as common
from .filter_audit import audit, cells


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op11_filter_audit": op11_filter_audit}

ORACLE = {
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
      w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
      l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
      f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
              [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
               regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
            FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
      c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
      k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
      o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
      s AS (SELECT part, array_to_string([chr((64 + x)::INT) for x in o], '') AS filter_order, i AS step, o[i] AS f, fails, n, good, toxic,
              fails[o[i]] AS here, len([x for x in o[:i - 1] if fails[x]]) > 0 AS gone, len([x for x in fails if x]) AS n_fails
            FROM c, o, k),
      m AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
              coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
              coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
            FROM s GROUP BY 1, 2, 3, 4)
      SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM m"""
}
