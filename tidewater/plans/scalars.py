"""Scalar families, sketches, percentiles and nested values in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def approx_distinct(spark, sf_dir):
    """A sketch (relative error 0.02) held against the exact count: is it within five of its errors?"""
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("sketch"), F.count_distinct("l_partkey").alias("exact"))
    return own.select("l_returnflag", "exact", (F.abs(F.col("sketch") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


def percentiles(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return own.agg(*[F.round(F.percentile("o_totalprice", q), 4).alias(n) for n, q in (("p10", 0.1), ("median", 0.5), ("p99", 0.99))], F.mode("o_orderstatus", deterministic=True).alias("status"))


def string_agg_sorted(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "; ").alias("nations"))


def first_last_nth(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(w).alias("last"), F.nth_value("o_orderkey", 3).over(w).alias("third"))


def regex_extract(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"Brand#([0-9]+)", 1).alias("number"), F.regexp_replace("p_name", r"[aeiou]", "*").alias("masked"), F.regexp_count("p_name", F.lit("[a-z]+")).cast("long").alias("words"), F.col("p_type").rlike("^S").alias("starts"))


def levenshtein_pairs(spark, sf_dir):
    """Nations of one region (a handful each) by how many edits their names are apart."""
    own = table(spark, sf_dir, "nation")
    one, two = own.select("n_regionkey", F.col("n_name").alias("a")), own.select("n_regionkey", F.col("n_name").alias("b"))
    return one.join(two, "n_regionkey").filter("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


def html_to_text(spark, sf_dir):
    """The text of pages: scripts, styles and comments go, then tags, then the five common entities and spare blanks."""
    text: Column = F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def url_parts(spark, sf_dir):
    part = lambda name: F.expr(f"try_parse_url(url, '{name}')")
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), F.expr("try_parse_url(url, 'QUERY', 'page')").alias("page"))


def date_funcs(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(d).cast("long").alias("y"),
        F.quarter(d).cast("long").alias("q"),
        F.month(d).cast("long").alias("m"),
        F.dayofyear(d).cast("long").alias("doy"),
        F.date_trunc("month", d).cast("timestamp_ntz").alias("month"),
        F.add_months(d, 2).alias("later"),
        F.last_day(d).alias("last"),
        F.datediff(F.lit("2002-01-01"), d).cast("long").alias("age"),
        F.date_format(d, "yyyy-MM-dd").alias("text"),
    )


def week_bucket(spark, sf_dir):
    week = F.date_trunc("week", F.col("ts")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def array_funcs(spark, sf_dir):
    v = F.col("v")
    return _vectors(spark, sf_dir).select(
        "vec_id",
        F.size(v).cast("long").alias("n"),
        F.round(F.array_max(v), 6).alias("largest"),
        F.round(F.array_min(v), 6).alias("smallest"),
        F.round(_sum(v), 5).alias("total"),
        F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(_sum(F.transform(F.slice(v, 1, 8), lambda x: x * x)), 6).alias("head"),
        F.exists(v, lambda x: x > 0.3).alias("any_large"),
    )


def cosine_similarity(spark, sf_dir):
    """Each vector against the mean vector of its label (ten labels, 64 numbers each)."""
    own = _vectors(spark, sf_dir)
    means = own.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("m"))
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y))
    return own.join(means, "label").select("vec_id", F.round(dot("v", "m") / F.sqrt(dot("v", "v") * dot("m", "m")), 6).alias("cosine"))


def explode_array(spark, sf_dir):
    return _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("place", "x")).groupBy("label", "place").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))


def map_funcs(spark, sf_dir):
    """Types of each user with their numbers as a map."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    some = F.map_filter("m", lambda k, v: v > 10)
    return maps.select("user_id", F.array_join(F.map_keys("m"), ",").alias("types"), F.coalesce(F.col("m")["click"], F.lit(0).cast("long")).alias("clicks"), F.cardinality(some).cast("long").alias("frequent"), F.map_contains_key("m", "error").alias("has_error"))


def struct_funcs(spark, sf_dir):
    """The dearest order of each customer as a struct that is compared field by field, then taken apart."""
    best = F.max(F.struct("o_totalprice", "o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state")))
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b"))
    return found.select("o_custkey", "b.o_totalprice", "b.o_orderkey", "b.state.status", F.upper("b.state.priority").alias("priority"))


def null_semantics(spark, sf_dir):
    """Three-valued logic over a column that is null in every third row."""
    v = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    own = table(spark, sf_dir, "nation").select("n_nationkey", v.alias("v"))
    v = F.col("v")
    return own.select("n_nationkey", (v > 5).alias("greater"), ((v > 5) | F.lit(True)).alias("or_true"), ((v > 5) & F.lit(False)).alias("and_false"), v.eqNullSafe(F.lit(None).cast("int")).alias("is_missing"), F.coalesce(v, F.lit(-1)).alias("filled"), F.nullif(v, F.lit(7)).alias("not_seven"), v.isin(1, 2).alias("listed"))


def lateral_topn(spark, sf_dir):
    """The two dearest orders of each customer by a lateral join of a correlated, limited subquery."""
    own = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders")
    best = orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2).select("o_orderkey", "o_totalprice")
    return own.lateralJoin(best).select("c_custkey", "o_orderkey", "o_totalprice")


def sampled_rows(spark, sf_dir):
    """A tenth of the customers by their keys' digest: the same ones in any engine and partition."""
    share = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return table(spark, sf_dir, "customer").filter(share < 0.1).select("c_custkey")


def pivot_types(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


def unpivot_measures(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return own.unpivot("l_returnflag", ["quantity", "discount", "tax"], "measure", "value")


QUERIES = {f.__name__: f for f in (approx_distinct, percentiles, string_agg_sorted, first_last_nth, regex_extract, levenshtein_pairs, html_to_text, url_parts, date_funcs, week_bucket, array_funcs, cosine_similarity, explode_array, map_funcs, struct_funcs, null_semantics, lateral_topn, sampled_rows, pivot_types, unpivot_measures)}

_TEXT = r"regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
for _entity, _sign in ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '[ \t\n\r]+', ' ', 'g'))"
_V = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
ORACLE = {
    "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS exact, true AS close FROM lineitem GROUP BY 1",
    "percentiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, (SELECT s FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders b WHERE b.o_orderpriority = a.o_orderpriority GROUP BY 1 ORDER BY n DESC, s LIMIT 1) m) AS status FROM orders a GROUP BY o_orderpriority",
    "string_agg_sorted": "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation GROUP BY 1",
    "first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "regex_extract": "SELECT p_partkey, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS number, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, len(regexp_extract_all(p_name, '[a-z]+'))::BIGINT AS words, starts_with(p_type, 'S') AS starts FROM part",
    "levenshtein_pairs": "SELECT x.n_name AS a, y.n_name AS b, levenshtein(x.n_name, y.n_name)::BIGINT AS edits FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name",
    "html_to_text": f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT page_id, {_TEXT} AS t FROM pages) x",
    "url_parts": r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages",
    "date_funcs": "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, month(o_orderdate)::BIGINT AS m, dayofyear(o_orderdate)::BIGINT AS doy, date_trunc('month', o_orderdate)::TIMESTAMP AS month, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE AS later, last_day(o_orderdate) AS last, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::BIGINT AS age, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders",
    "week_bucket": "SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2",
    "array_funcs": _V + " SELECT vec_id, len(v)::BIGINT AS n, round(list_max(v), 6) AS largest, round(list_min(v), 6) AS smallest, round(list_sum(v), 5) AS total, len(list_filter(v, lambda x: x > 0))::BIGINT AS positive, round(list_sum(list_transform(v[1:8], lambda x: x * x)), 6) AS head, list_max(v) > 0.3 AS any_large FROM e",
    "cosine_similarity": _V + ", m AS (SELECT label, list(x ORDER BY p) AS m FROM (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) a GROUP BY ALL) b GROUP BY label) SELECT vec_id, round(list_cosine_similarity(v, m), 6) AS cosine FROM e JOIN m USING (label)",
    "explode_array": _V + " SELECT label, (p - 1)::INT AS place, round(avg(x), 6) AS mean, count(*)::BIGINT AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) a GROUP BY ALL",
    "map_funcs": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, coalesce(max(n) FILTER (event_type = 'click'), 0)::BIGINT AS clicks, count(*) FILTER (n > 10)::BIGINT AS frequent, bool_or(event_type = 'error') AS has_error FROM c GROUP BY 1",
    "struct_funcs": "SELECT o_custkey, o_totalprice, o_orderkey, o_orderstatus AS status, upper(o_orderpriority) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) x WHERE r = 1",
    "null_semantics": "WITH o AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS v FROM nation) SELECT n_nationkey, v > 5 AS greater, v > 5 OR true AS or_true, v > 5 AND false AS and_false, v IS NOT DISTINCT FROM NULL AS is_missing, coalesce(v, -1) AS filled, nullif(v, 7) AS not_seven, v IN (1, 2) AS listed FROM o",
    "lateral_topn": "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x JOIN customer USING (c_custkey) WHERE r <= 2",
    "sampled_rows": "SELECT c_custkey FROM customer WHERE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.1",
    "pivot_types": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}')::BIGINT AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "unpivot_measures": " UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS measure, round({e}, {d}) AS value FROM lineitem GROUP BY 1" for n, e, d in (("quantity", "sum(l_quantity)", 2), ("discount", "avg(l_discount)", 6), ("tax", "avg(l_tax)", 6))),
}
