"""Selections under risk over years of sales, and plans over the quarters of a year.

Draws of a part are its quantities sold in each year that the sales have: all parts share their years.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio
from ..session import table
from .selection import BUDGET, CAP, SIZE

#: Worst share of the years, and the weight of the mean over all of them, in percent.
WORST, WEIGHT = 30, 40
#: Cost of a change of size from a quarter to the next, in units sold.
CHANGE = 60


def select_cvar(spark, sf_dir):
    """Three parts of each brand by their mean sales of a year and those of its worst years."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").cast("long").alias("n"))
    years = sold.select("year").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("item"), F.col("p_type").alias("kind"), F.round(F.col("p_retailprice") * 10).cast("long").alias("price"))
    whole = sold.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("by_year"))
    all_years = years.agg(F.array_sort(F.collect_list("year")).alias("years"))  # a handful
    items = parts.join(whole, "item").crossJoin(F.broadcast(all_years)).withColumn("draws", F.transform("years", lambda y: F.coalesce(F.try_element_at("by_year", y), F.lit(0).cast("long"))))
    rules = parts.select("grp").distinct().select("grp", F.lit(SIZE).alias("size"), F.lit(CAP).alias("cap"), F.lit(BUDGET).cast("long").alias("budget"))
    found = portfolio.select_under_risk(items, rules, WORST, WEIGHT)
    return found.select("grp", "status", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "objective", "total", "tail", "price")


def plan_quarters(spark, sf_dir):
    """Of each brand a size for each quarter of the year, by units sold, where a change costs."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    values = sold.groupBy(F.col("p_brand").alias("grp"), F.quarter("l_shipdate").alias("period"), F.col("p_size").cast("string").alias("state")).agg(F.sum("l_quantity").cast("long").alias("value"))
    found = portfolio.choose_over_periods(values, CHANGE)
    return found.select("grp", "status", F.array_join("states", ",").alias("states"), F.col("changes").cast("long").alias("changes"), "total")


QUERIES = {"select_cvar": select_cvar, "plan_quarters": plan_quarters}


def _step(k: int) -> str:
    return f"""s{k} AS (SELECT grp, state, score, way FROM (SELECT v.grp, v.state, v.value + p.score - CASE WHEN p.state = v.state THEN 0 ELSE {CHANGE} END AS score, p.way || ',' || v.state AS way,
        row_number() OVER (PARTITION BY v.grp, v.state ORDER BY p.score - CASE WHEN p.state = v.state THEN 0 ELSE {CHANGE} END DESC, CASE WHEN p.state = v.state THEN 0 ELSE 1 END, p.state) AS r
      FROM v JOIN s{k - 1} p ON p.grp = v.grp WHERE v.period = {k}) q WHERE r = 1)"""


ORACLE = {
    "select_cvar": f"""WITH y AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem), s AS (SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL),
      d AS (SELECT l_partkey AS item, list(coalesce(n, 0) ORDER BY y) AS d FROM (SELECT p.l_partkey, y.y, s.n FROM (SELECT DISTINCT l_partkey FROM s) p, y LEFT JOIN s ON s.l_partkey = p.l_partkey AND s.y = y.y) z GROUP BY 1),
      i AS (SELECT p_brand AS grp, item, p_type AS kind, round(p_retailprice * 10)::BIGINT AS price, d FROM part JOIN d ON item = p_partkey),
      t AS (SELECT a.grp, a.item AS x, b.item AS y, c.item AS z, a.price + b.price + c.price AS price, [e[1] + e[2] + e[3] for e in list_zip(a.d, b.d, c.d)] AS t FROM i a JOIN i b ON a.grp = b.grp AND a.item < b.item JOIN i c ON b.grp = c.grp AND b.item < c.item WHERE NOT (a.kind = b.kind AND b.kind = c.kind) AND a.price + b.price + c.price <= {BUDGET}),
      k AS (SELECT *, ((len(t) * {WORST} + 99) // 100)::BIGINT AS k, list_sum(t)::BIGINT AS total FROM t), o AS (SELECT *, list_sum(list_sort(t)[1:k])::BIGINT AS tail FROM k),
      v AS (SELECT *, {WEIGHT} * k * total + {100 - WEIGHT} * len(t) * tail AS objective FROM o)
      SELECT g.grp, CASE WHEN r IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, x::VARCHAR || ',' || y || ',' || z AS items, objective::BIGINT AS objective, total, tail, price
      FROM (SELECT DISTINCT grp FROM i) g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY objective DESC, price, x, y, z) AS r FROM v QUALIFY r = 1) b ON b.grp = g.grp""",
    "plan_quarters": "WITH v AS (SELECT p_brand AS grp, quarter(l_shipdate) AS period, p_size::VARCHAR AS state, sum(l_quantity)::BIGINT AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s1 AS (SELECT grp, state, value AS score, state AS way FROM v WHERE period = 1), "
    + ", ".join(_step(k) for k in (2, 3, 4))
    + ", b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, state) AS r FROM s4) SELECT g.grp, CASE WHEN way IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, way AS states, CASE WHEN way IS NOT NULL THEN len([i for i in [2, 3, 4] if string_split(way, ',')[i] <> string_split(way, ',')[i - 1]]) END::BIGINT AS changes, score::BIGINT AS total FROM (SELECT DISTINCT grp FROM v) g LEFT JOIN b ON b.grp = g.grp AND r = 1",
}
