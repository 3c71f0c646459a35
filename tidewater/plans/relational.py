"""General relational coverage as DataFrame plans, each held against a SQL statement.

``STATEMENTS`` are what DuckDB runs; ``run`` takes the same texts in Spark, where
one engine's SQL is to be compared with its own DataFrame plan.  Every output
column is named and cast, so widths and names agree; sums of doubles are rounded
as addition order is free.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

STATEMENTS: dict[str, str] = {
    "scan_parquet": "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 49 AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "filter_project": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')",
    "case_bucket": "SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS bucket FROM orders) x GROUP BY bucket",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "star_join": """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "semi_join_orders": "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "exists_subquery": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "count_distinct": "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "filter_agg": "SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high, round(sum(value) FILTER (WHERE value <= 50), 4) AS low_sum FROM events GROUP BY event_type",
    "rollup_region_nation": "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "cube_flag_status": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12",
    "max_by_min_by": "SELECT user_id, max_by(event_id, ts) AS last_event, min_by(event_id, ts) AS first_event FROM events GROUP BY user_id",
    "stats_corr_regr": "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY l_linestatus",
    "rank_functions": """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "lag_lead": "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "running_total_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM events",
    "moving_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
    "range_interval_frame": "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events",
    "topn_per_group": "SELECT n_nationkey, s_suppkey, s_acctbal FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) x WHERE r <= 3",
    "order_limit_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10",
    "nulls_ordering": "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM nation) x ORDER BY v NULLS FIRST, k LIMIT 12",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except_distinct": "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 47",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "string_funcs": "SELECT c_custkey, upper(c_mktsegment) AS u, substring(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS p, trim(concat(' ', c_mktsegment, ' ')) AS t, CAST(length(c_name) AS BIGINT) AS n FROM customer",
    "math_funcs": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS q, round(ln(p_retailprice), 6) AS l, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a FROM part",
    "money_tenths": "SELECT p_brand, CAST(sum(CAST(round(p_retailprice * 10) AS BIGINT)) AS BIGINT) AS tenths FROM part GROUP BY p_brand",
    "dq_uniqueness": "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dq_ranges": "SELECT CAST(count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50) AS BIGINT) AS quantity, CAST(count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1) AS BIGINT) AS discount, CAST(count(*) FILTER (WHERE l_tax < 0 OR l_tax > 0.08) AS BIGINT) AS tax FROM lineitem",
    "dq_missingness": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(text) AS BIGINT) AS text, CAST(count(*) - count(lang) AS BIGINT) AS lang, CAST(count(*) - count(source) AS BIGINT) AS source FROM documents",
    "exact_dedup": "SELECT md5(text) AS h, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY md5(text)",
    "content_hash": "SELECT doc_id, md5(text) AS h, CAST(length(text) AS BIGINT) AS n FROM documents",
    "pseudonymise": "SELECT md5(concat('salt-1:', CAST(c_custkey AS VARCHAR(20)))) AS pseudonym, c_mktsegment, c_nationkey FROM customer",
    "budget_breach": """SELECT conv_id, min(turn) AS first_breach FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) x WHERE used > 2000 OR turn >= 6 GROUP BY conv_id""",
    "ep_topk": "SELECT p_brand, p_partkey, value FROM (SELECT p_brand, p_partkey, value, row_number() OVER (PARTITION BY p_brand ORDER BY value DESC, p_partkey) AS r FROM (SELECT p_brand, p_partkey, round(sum(l_quantity * (1 - l_discount)), 4) AS value FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) y) x WHERE r <= 2",
    "candidate_compare": "SELECT o_custkey, o_orderkey, round(o_totalprice - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 4) AS margin, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place FROM orders",
    # pairs of events of one user with differing types and values, counted without making them: all pairs of two types less those of equal values
    "source_contradictions": """WITH c AS (SELECT user_id, event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type, value),
        t AS (SELECT user_id, event_type, sum(n) AS n FROM c GROUP BY user_id, event_type),
        p AS (SELECT a.user_id, a.event_type AS type_a, b.event_type AS type_b, a.n * b.n AS n FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type < b.event_type),
        s AS (SELECT a.user_id, a.event_type AS type_a, b.event_type AS type_b, sum(a.n * b.n) AS n FROM c a JOIN c b ON a.user_id = b.user_id AND a.value = b.value AND a.event_type < b.event_type GROUP BY a.user_id, a.event_type, b.event_type)
        SELECT p.user_id, p.type_a, p.type_b, CAST(p.n - coalesce(s.n, 0) AS BIGINT) AS n FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.type_a = s.type_a AND p.type_b = s.type_b WHERE p.n > coalesce(s.n, 0)""",
    "slice_report": "SELECT event_type, CAST(user_id % 10 AS INT) AS slice, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type, CAST(user_id % 10 AS INT)), (event_type), ())",
    "rate_limit_breach": "SELECT event_id, user_id, n FROM (SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events) x WHERE n > 1",
}


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the tables below ``sf_dir``; each that it names is read with the columns it needs."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]
    named = re.sub(rf"\b((?:FROM|JOIN)\s+)({'|'.join(TABLES)})\b", r"\1{\2}", statement)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in named})


def _ts(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _of(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def _n(name: str = "n") -> Column:
    return F.count("*").alias(name)


def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations of customers and of suppliers."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 49) & (F.col("l_shipdate") >= _ts("1998-01-01 00:00:00"))).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")


def filter_project(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").filter(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24) & F.col("l_returnflag").isin("A", "R"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(_revenue(), 4).alias("revenue"))


def case_bucket(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.when(price < 50000, "low").when(price < 200000, "middle").otherwise("high").alias("bucket")).agg(_n())


def pricing_summary(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= _ts("2001-09-02 00:00:00")).groupBy("l_returnflag", "l_linestatus")
    sums = {"sum_qty": F.sum("l_quantity"), "sum_base": F.sum("l_extendedprice"), "sum_disc": F.sum(_revenue())}
    means = {"avg_qty": F.avg("l_quantity"), "avg_disc": F.avg("l_discount")}
    return own.agg(*[F.round(c, 2).alias(n) for n, c in sums.items()], *[F.round(c, 6).alias(n) for n, c in means.items()], _n())


def star_join(spark, sf_dir):
    lines, orders, customers, nations, regions = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    whole = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return whole.groupBy("r_name", "n_name").agg(_n(), F.round(F.sum(_revenue()), 2).alias("revenue"))


def semi_join_orders(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(large, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


def scalar_subquery(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return own.filter(F.col("c_acctbal") > own.select(F.avg("c_acctbal")).scalar())


def exists_subquery(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").filter((F.col("o_custkey") == F.col("c_custkey").outer()) & (F.col("o_totalprice") > 300000))
    return table(spark, sf_dir, "customer").filter(~dear.exists()).select("c_custkey")


def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def filter_agg(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(value > 50).alias("high"), F.round(F.sum(F.when(value <= 50, value)), 4).alias("low_sum"))


def rollup_region_nation(spark, sf_dir):
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(_n())


def cube_flag_status(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(_n(), F.round(F.avg("l_quantity"), 6).alias("avg_qty"))


def grouping_sets(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority).agg(_n())


def having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(_n()).filter("n >= 12")


def max_by_min_by(spark, sf_dir):
    """Of events at one time the later id is the last one and the earlier the first."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("last_event"), F.min_by("event_id", at).alias("first_event"))


def stats_corr_regr(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"))


def rank_functions(spark, sf_dir):
    w = _of("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "nt": F.ntile(4)}
    shares = {"pr": F.percent_rank(), "cd": F.cume_dist()}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.over(w).cast("long").alias(n) for n, c in whole.items()], *[F.round(c.over(w), 9).alias(n) for n, c in shares.items()])


def lag_lead(spark, sf_dir):
    w = _of("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value", 1).over(w).alias("before"), F.lead("value", 2).over(w).alias("after"))


def running_total_rows(spark, sf_dir):
    w = _of("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))


def moving_avg_rows(spark, sf_dir):
    w = _of("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


def _within(interval: str) -> Column:
    """Rows of the user up to and with this one that are at most ``interval`` old; the API has no frames of intervals, so this one is an expression."""
    return F.expr(f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")


def range_interval_frame(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", _within("'1' DAY").alias("n"))


def topn_per_group(spark, sf_dir):
    w = _of("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(w)).filter("r <= 3").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")


def order_limit_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(20)


def nulls_ordering(spark, sf_dir):
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("v"))
    return own.orderBy(F.asc_nulls_first("v"), "k").limit(12)


def union_all(spark, sf_dir):
    customers, suppliers = _keys(spark, sf_dir)
    return customers.unionByName(suppliers)


def union_distinct(spark, sf_dir):
    return union_all(spark, sf_dir).distinct()


def intersect(spark, sf_dir):
    customers, suppliers = _keys(spark, sf_dir)
    return customers.intersect(suppliers)


def except_distinct(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_partkey").alias("k")).subtract(own.filter("l_quantity > 47").select(F.col("l_partkey").alias("k")))


def intersect_all(spark, sf_dir):
    customers, suppliers = _keys(spark, sf_dir)
    return customers.intersectAll(suppliers)


def except_all(spark, sf_dir):
    customers, suppliers = _keys(spark, sf_dir)
    return customers.exceptAll(suppliers)


def string_funcs(spark, sf_dir):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key,
        F.upper(segment).alias("u"),
        F.substring("c_name", 1, 8).alias("s"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("r"),
        F.lpad(key.cast("string"), 8, "0").alias("p"),
        F.trim(F.concat(F.lit(" "), segment, F.lit(" "))).alias("t"),
        F.length("c_name").cast("long").alias("n"),
    )


def math_funcs(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.sqrt(price), 6).alias("q"), F.round(F.ln(price), 6).alias("l"), F.floor(price).alias("f"), F.ceil(price).alias("c"), F.abs(F.col("p_size") - 25).alias("a"))


def money_tenths(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.round(F.col("p_retailprice") * 10).cast("long")).alias("tenths"))


def dq_uniqueness(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(_n()).filter("n > 1")


def dq_ranges(spark, sf_dir):
    bounds = {"quantity": ("l_quantity", 1, 50), "discount": ("l_discount", 0, 0.1), "tax": ("l_tax", 0, 0.08)}
    return table(spark, sf_dir, "lineitem").agg(*[F.count_if(~F.col(c).between(lo, hi)).alias(n) for n, (c, lo, hi) in bounds.items()])


def dq_missingness(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(_n(), *[F.count_if(F.col(c).isNull()).alias(c) for c in ("text", "lang", "source")])


def exact_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), _n("copies"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.length("text").cast("long").alias("n"))


def pseudonymise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.md5(F.concat(F.lit("salt-1:"), F.col("c_custkey").cast("string"))).alias("pseudonym"), "c_mktsegment", "c_nationkey")


def budget_breach(spark, sf_dir):
    w = _of("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used"))
    return own.filter("used > 2000 or turn >= 6").groupBy("conv_id").agg(F.min("turn").alias("first_breach"))


def ep_topk(spark, sf_dir):
    value = F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 4)
    own = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_partkey").agg(value.alias("value"))
    return own.withColumn("r", F.row_number().over(_of("p_brand").orderBy(F.desc("value"), "p_partkey"))).filter("r <= 2").drop("r")


def candidate_compare(spark, sf_dir):
    price, w = F.col("o_totalprice"), _of("o_custkey").orderBy(F.desc("o_totalprice"))
    ordered = _of("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(price - F.lead(price).over(ordered), 4).alias("margin"), F.dense_rank().over(w).cast("long").alias("place"))


def source_contradictions(spark, sf_dir):
    """Pairs of events of one user with differing types and values, counted without making them: all pairs of two types less those of equal values."""
    same = table(spark, sf_dir, "events").filter("value is not null").groupBy("user_id", "event_type", "value").agg(_n())
    whole = same.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))

    def pairs(counts: DataFrame, on: list[str]) -> DataFrame:
        a, b = counts.withColumnsRenamed({"event_type": "type_a", "n": "na"}), counts.withColumnsRenamed({"event_type": "type_b", "n": "nb"})
        return a.join(b, on).filter("type_a < type_b").groupBy("user_id", "type_a", "type_b").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))

    equal = pairs(same, ["user_id", "value"]).withColumnRenamed("n", "equal")
    found = pairs(whole, ["user_id"]).join(equal, ["user_id", "type_a", "type_b"], "left")
    return found.select("user_id", "type_a", "type_b", (F.col("n") - F.coalesce("equal", F.lit(0))).alias("n")).filter("n > 0")


def slice_report(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("slice", (F.col("user_id") % 10).cast("int"))
    kind, part = F.col("event_type"), F.col("slice")
    return own.groupingSets([[kind, part], [kind], []], kind, part).agg(_n(), F.round(F.avg("value"), 6).alias("mean"))


def rate_limit_breach(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", _within("'1' HOUR").alias("n")).filter("n > 1")


QUERIES = {name: globals()[name] for name in STATEMENTS}
ORACLE = dict(STATEMENTS)
