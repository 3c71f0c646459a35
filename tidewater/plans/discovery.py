"""Near duplicates among curated entities, and retrieval within a scope and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import near_duplicates as near
from ..operators import retrieval
from ..session import table

K, QUERIES_EVERY = 5, 100


def near_dup_minhash(spark, sf_dir):
    """Each document's class of equal texts and of near duplicates at a Jaccard similarity of 0.8."""
    found = near.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "representative", "class_id")


def _vectors(spark, sf_dir, scoped=True):
    """Vectors with their label as scope; a vector is known from the day that its id gives, of thirty."""
    day = F.make_dt_interval((F.col("vec_id") % 30).cast("int"))
    own = table(spark, sf_dir, "embeddings").withColumn("known", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + day)
    return retrieval.usable(own, "vec_id", "embedding", *(("label", "known") if scoped else ()))


def _nearest(rows, centres, probes):
    queries = rows.filter(F.col("id") % QUERIES_EVERY == 0)
    found = retrieval.search(retrieval.assigned(rows, centres), retrieval.assigned(queries, centres, probes), K)
    return found.select("query", F.col("id").alias("vec_id"), "score")


def retrieval_topk(spark, sf_dir):
    """Nearest five of each query vector (ids divisible by 100), by the dot product of unit vectors, exactly."""
    return _nearest(_vectors(spark, sf_dir, scoped=False), None, 1)


def retrieval_scoped(spark, sf_dir):
    """Nearest five of each query vector among those of its label that were known by its day, exactly."""
    return _nearest(_vectors(spark, sf_dir), None, 1)


#: Share of the lists that a query looks into: the vectors here hardly cluster, and few are of a query's label and known by its day.
PROBED = 0.8


def retrieval_inverted_lists(spark, sf_dir):
    """The same through inverted lists; its recall of ``retrieval_scoped`` is tested."""
    rows = _vectors(spark, sf_dir)
    centres = retrieval.quantiser(rows)
    return _nearest(rows, centres, max(1, round(PROBED * len(centres))))


QUERIES = {f.__name__: f for f in (near_dup_minhash, retrieval_topk, retrieval_scoped, retrieval_inverted_lists)}

_HASHES = "[" + ", ".join(f"list_min([({a} * (x % {near.PRIME}) + {b}) % {near.PRIME} for x in xs])" for a, b in near.coefficients(near.BANDS * near.ROWS)) + "]"
ORACLE = {
    "near_dup_minhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
      s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct([('0x' || substr(md5(array_to_string(ws[i:i + {near.WORDS - 1}], ' ')), 1, 15))::BIGINT for i in range(1, greatest(len(ws) - {near.WORDS - 1}, 1) + 1)])) END AS xs FROM w),
      r AS MATERIALIZED (SELECT min(doc_id) AS id, xs FROM s GROUP BY xs),
      h AS MATERIALIZED (SELECT id, xs, {_HASHES} AS hs FROM r WHERE len(xs) > 0),
      k AS (SELECT id, b, hs[b * {near.ROWS} + 1:b * {near.ROWS} + {near.ROWS}] AS key FROM h, range({near.BANDS}) t(b)),
      p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.b = y.b AND x.key = y.key AND x.id < y.id),
      l AS MATERIALIZED (SELECT a, b FROM (SELECT p.a, p.b, len(list_intersect(x.xs, y.xs)) AS n, len(x.xs) + len(y.xs) AS m FROM p JOIN h x ON x.id = p.a JOIN h y ON y.id = p.b) q WHERE n >= {near.SIMILARITY}::DOUBLE * (m - n)),
      e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      c AS (SELECT id AS node, id AS root FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
      g AS (SELECT node, min(root) AS class_id FROM c GROUP BY 1)
      SELECT s.doc_id, r.id AS representative, g.class_id FROM s JOIN r ON r.xs = s.xs JOIN g ON g.node = r.id""",
    "retrieval_topk": "WITH p AS (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM p) x WHERE r <= 5",
    "retrieval_scoped": "WITH p AS (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND q.label = e.label AND e.vec_id % 30 <= q.vec_id % 30) SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM p) x WHERE r <= 5",
}
