"""Query of the line-first quality rules over all documents, and its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _common as common
from . import line_quality as q


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.judge(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_SOLID = "regexp_replace({}, '[ \\t-\\r]', '', 'g')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
pos AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM dup WHERE n > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(i - p, 3))) AS n FROM pos GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
m AS (
  SELECT doc_id, line, {_SOLID.format("line")} AS s,
    len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) AS nw,
    len(list_distinct(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> ''))) AS variety,
    len(regexp_extract_all(line, '[|>»›•·]')) AS seps,
    len(regexp_extract_all(line, '[!?]{{2,}}(?:[ \t-\r]|$)')) AS shouts
  FROM l),
f AS (
  SELECT doc_id, line, s, length(s) > 0 AND (
    length(s) - length(translate(s, '{q.SYMBOLS}', '')) > {q.MAX_SYMBOLS} * length(s)
    OR (nw >= {q.SHOUT_WORDS} AND (
      length(s) - length(regexp_replace(s, '\p{{Lu}}', '', 'g')) > {q.MAX_CAPITALS} * (length(s) - length(regexp_replace(s, '\p{{L}}', '', 'g')))
      OR shouts > {q.MAX_SHOUTS} * nw))
    OR (seps >= 2 AND 3 * seps >= nw)
    OR (nw >= {q.VARIETY_WORDS} AND variety < {q.MIN_VARIETY} * nw)
    OR (regexp_matches(line, '{q.BOILERPLATE}') AND nw <= 12)) AS fails
  FROM m),
k AS (SELECT doc_id, coalesce(sum(length(s)) FILTER (NOT fails), 0) AS kept_chars, count(*) FILTER (length(s) > 0) - count(DISTINCT line) FILTER (length(s) > 0) AS n_dup FROM f GROUP BY doc_id),
r AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length({_SOLID.format("t")})::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
    k.n_dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, k.kept_chars
  FROM w LEFT JOIN rep USING (doc_id) JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
    AND kept_chars >= (1 - {q.MAX_LOST}::DOUBLE) * word_chars AS kept
FROM r
"""

QUERIES = {"op6_line_quality": op6_line_quality}
ORACLE = {"op6_line_quality": ORACLE_SQL}
