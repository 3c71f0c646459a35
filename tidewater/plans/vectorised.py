"""Queries through functions of one's own, one of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectorised
from ..session import table


def udf_scalar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(vectorised.soft_cap("value", F.lit(20.0)), 6).alias("capped"))


def udf_grouped_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.round(vectorised.geometric_mean(F.abs("s_acctbal") + 1), 4).alias("mean"))


def udf_map_batches(spark, sf_dir):
    return vectorised.with_checksum(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", "checksum")


def udf_apply_groups(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return vectorised.trend(own, "user_id", "x", "y").select("user_id", F.round("slope", 6).alias("slope"), "n")


def udf_cogroup(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    asked = own.filter("event_type = 'purchase'").select("user_id", "day", "ts", F.col("event_id").alias("id"))
    told = own.filter("event_type <> 'purchase'").select("user_id", "day", "ts", "value")
    return vectorised.last_before(asked, told, ["user_id", "day"], "ts")


def udtf_words(spark, sf_dir):
    words = table(spark, sf_dir, "part").lateralJoin(vectorised.SplitWords(F.col("p_name").outer()))
    return words.groupBy("word", "place").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (udf_scalar, udf_grouped_agg, udf_map_batches, udf_apply_groups, udf_cogroup, udtf_words)}
ORACLE = {
    "udf_scalar": "SELECT event_id, round(CASE WHEN value <= 20 THEN value ELSE 20 + ln(1 + value - 20) END, 6) AS capped FROM events",
    "udf_grouped_agg": "SELECT n_name, round(exp(avg(ln(abs(s_acctbal) + 1))), 4) AS mean FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1",
    "udf_map_batches": "SELECT c_custkey, list_sum(list_transform(string_split(c_name, ''), lambda x: unicode(x)))::BIGINT AS checksum FROM customer",
    "udf_apply_groups": "SELECT user_id, round(regr_slope(event_id % 100, value), 6) AS slope, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "udf_cogroup": "SELECT d.event_id AS id, (SELECT o.value FROM events o WHERE o.user_id = d.user_id AND o.ts::DATE = d.ts::DATE AND o.event_type <> 'purchase' AND o.ts < d.ts ORDER BY o.ts DESC LIMIT 1) AS value FROM events d WHERE d.event_type = 'purchase'",
    "udtf_words": "SELECT word, place::INT AS place, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part) x GROUP BY ALL",
}
