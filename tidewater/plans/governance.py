"""Data governance over the driver's tables: admission, zones, quality, claims, lineage, deletion.

The tables are clean, so the faults that a check has to find are planted by a
rule that its docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import deletion, lineage, ordering, rules
from ..session import durable, table
from .evidence import OBSERVATIONS, observations

FIELDS = ["owner", "licence", "cadence", "retention"]


def _hex(column: str, k: int) -> Column:
    """The k-th hexadecimal digit of a text's digest."""
    return F.substring(F.md5(F.col(column)), k, 1)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the documents with their admission fields; a field is missing where a digit of the name's digest is 0 to 2."""
    own = table(spark, sf_dir, "documents").select("source").distinct()
    return own.select("source", *[F.when(_hex("source", k) > "2", F.lit("given")).alias(f) for k, f in enumerate(FIELDS, start=1)])


ADMISSION = [(f, f, "required", None) for f in FIELDS]


def source_admission(spark, sf_dir):
    """Sources lacking a mandatory field, and the documents that stay out with them."""
    refused = rules.broken(sources(spark, sf_dir), ADMISSION).select("source", F.array_join("broken", ",").alias("missing")).filter("missing <> ''")
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return counts.join(refused, "source")


ZONES = ["quarantine", "raw", "curated", "features", "serving"]


def zone_transitions(spark, sf_dir):
    """Promotions that skip or go back a zone: an object (customer) moves a zone on with each order, every seventh order moves it two."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf_dir, "orders").withColumn("k", F.sum(F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.array(*[F.lit(z) for z in ZONES])
    moves = steps.select(F.col("o_custkey").alias("object_id"), "o_orderkey", F.get(names, (F.col("k") % 5).cast("int")).alias("to_zone"), F.coalesce(F.get(names, (F.lag("k").over(w) % 5).cast("int")), F.lit("quarantine")).alias("from_zone"))
    allowed = spark.createDataFrame(list(zip(ZONES, ZONES[1:])), "from_zone string, to_zone string")
    return moves.join(F.broadcast(allowed), ["from_zone", "to_zone"], "left_anti").groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("objects"))


def schema_quarantine(spark, sf_dir):
    """Quantities as texts, every fiftieth part's malformed: what doesn't cast goes to quarantine with its text, nothing is coerced."""
    k = F.col("l_partkey") % 50
    raw = F.when(k == 0, "n/a").when(k == 1, "").when(k == 2, "12x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    own = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).withColumn("value", F.expr("try_cast(raw AS int)"))
    bad = F.col("raw").isNotNull() & F.col("value").isNull()
    return own.groupBy(F.when(bad, "quarantine").otherwise("accepted").alias("state"), F.when(bad, F.col("raw")).alias("text")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dq_referential(spark, sf_dir):
    """Lines without their order, against a snapshot that lost every 13th order."""
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("orphans"))


def dq_timeliness(spark, sf_dir):
    """Hours from observation to availability, by revision."""
    hours = (F.unix_micros(F.col("available_at").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 3.6e9
    own = observations(spark, sf_dir).select("revision", hours.alias("hours"))
    return own.groupBy("revision").agg(F.percentile("hours", 0.5).alias("median"), F.percentile("hours", 0.95).alias("p95"), F.max("hours").alias("longest"), F.round(F.avg((F.col("hours") > 24).cast("double")), 6).alias("late"))


def drift_ks(spark, sf_dir):
    """Kolmogorov-Smirnov distance of the values of both halves: the greatest gap between their distribution functions."""
    half = F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    own = table(spark, sf_dir, "events").select("value", half.alias("later"))
    upto = ordering.running(own, "value", {"a": "CASE WHEN later THEN 0 ELSE 1 END", "b": "CASE WHEN later THEN 1 ELSE 0 END"})
    sizes = own.agg(F.count_if(~F.col("later")).alias("na"), F.count_if("later").alias("nb"))
    return upto.crossJoin(F.broadcast(sizes)).agg(F.round(F.max(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))), 6).alias("ks"), F.count("*").alias("different"))


def cross_source_conflict(spark, sf_dir):
    """Days of a user on which sources (types) give different values: folded to each source's bounds first, so no pairs are made."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    each = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day"), "event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found = each.groupBy("user_id", "day").agg(F.count("*").alias("sources"), F.min("low").alias("low"), F.max("high").alias("high"))
    return found.filter("sources > 1 and low <> high")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of 15 characters of each document at a place that its id gives; every eighth one's place is off by one."""
    start = (F.col("doc_id") % 20 + 1).cast("int")
    off = F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", start.alias("start"), F.substring(F.col("text"), start + off, F.lit(15)).alias("quote"))


def claim_span_check(spark, sf_dir):
    return claims(spark, sf_dir).select("doc_id", (F.substring(F.col("text"), F.col("start"), F.lit(15)) == F.col("quote")).alias("holds"))


def claim_corroboration(spark, sf_dir):
    """Claims (sentences of whole texts) that two sources or more make may be promoted."""
    sentences = F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x))
    own = table(spark, sf_dir, "documents").select(F.explode(F.filter(sentences, lambda x: x != "")).alias("claim"), "source").select(F.md5("claim").alias("claim"), "source")
    by_source = own.groupBy("claim", "source").agg(F.count("*").alias("n"))  # a claim that all texts make is a row for each source from here
    found = by_source.groupBy("claim").agg(F.count("source").alias("sources"), F.sum("n").alias("n"))
    return found.withColumn("promoted", F.col("sources") >= 2)


def claim_validity(spark, sf_dir):
    """Claims that hold on the 15th: available, not expired (half-open, one to ten days by id) and of a confidence of 0.5 or more."""
    at = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    until = F.col("ts") + F.make_dt_interval((F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").filter((F.col("ts") <= at) & (until > at) & (F.col("value") >= 50)).select("event_id", "user_id", until.alias("expires_at"))


def collection_failures(spark, sf_dir):
    """Each source (type) that the table has is due on each day of its span; a day without rows stays in the report as failed.  Errors are lost on every sixth day."""
    day = F.datediff("ts", F.lit("2024-01-01"))
    own = durable(table(spark, sf_dir, "events").groupBy(day.alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("n")))
    span = own.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    due = own.select("source").distinct().crossJoin(F.broadcast(span)).select("source", F.explode(F.sequence("a", "b")).alias("day"))  # types times one row
    got = own.filter("not (source = 'error' and day % 6 = 0)")
    return due.join(got, ["day", "source"], "left").select("day", "source", F.when(F.col("n").isNull(), "failed").otherwise("collected").alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def deletion_effect(spark, sf_dir):
    """What a deletion list (customers in debt) took from each written zone, and what of it is left: the features' job forgot customers of odd numbers and took every 50th one's too."""
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("person"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey").select("person")
    before = {"raw": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person")), "curated": orders.select("person"), "features": lines}
    wrong = gone.filter("person % 2 = 0")
    now = {zone: durable(rows.join(wrong if zone == "features" else gone, "person", "left_anti").filter("true" if zone != "features" else "person % 50 <> 7")) for zone, rows in before.items()}
    return deletion.effect({zone: (before[zone], now[zone]) for zone in before}, gone, "person")


def lineage_closure(spark, sf_dir):
    """All upstream snapshots of each: a part's snapshot rests on those of a half and of a third of its number."""
    key = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").filter("p_partkey > 0").select(key.alias("snapshot"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("upstream"))
    return lineage.closure(edges).select("snapshot", "upstream", F.col("depth").cast("long").alias("depth"))


# Patterns that both engines read alike; no backtracking is needed for any.
SECRETS = {"access_key": r"AKIA[0-9A-Z]{16}", "token": r"gh[pousr]_[A-Za-z0-9]{20,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "assigned": r"(?i)(api[_-]?key|secret|password|token)[ ]*[=:][ ]*[^ \n]{8,}"}
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "phone": r"\+[0-9][0-9() .-]{7,}[0-9]"}


def _scan(patterns: dict[str, str]):
    def query(spark, sf_dir):
        counts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in patterns.items()]))
        return table(spark, sf_dir, "documents").select("doc_id", counts.alias("c")).select("doc_id", "c.*").filter("n > 0")

    return query


SECTIONS = ["purpose", "sources", "coverage", "quality", "limits", "owner"]


CARD = [(s, s, "required", None) for s in SECTIONS]


def card_completeness(spark, sf_dir):
    """Cards (a nation each) with sections; a card lacks a section where its number and the section's add up to a multiple of five."""
    text = lambda k, s: F.when((F.col("n_nationkey") + k) % 5 != 0, F.concat(F.lit(f"{s} of "), "n_name")).alias(s)
    cards = table(spark, sf_dir, "nation").select(F.col("n_name").alias("card"), *[text(k, s) for k, s in enumerate(SECTIONS)])
    found = rules.broken(cards, CARD, "missing")
    return found.select("card", F.array_join("missing", ",").alias("missing"), F.size("missing").cast("long").alias("n_missing"), (F.size("missing") == 0).alias("complete"))


QUERIES = {f.__name__: f for f in (source_admission, zone_transitions, schema_quarantine, dq_referential, dq_timeliness, drift_ks, cross_source_conflict, claim_span_check, claim_corroboration, claim_validity, collection_failures, deletion_effect, lineage_closure, card_completeness)} | {"secret_scan": _scan(SECRETS), "pii_scan": _scan(PERSONAL)}


def _scan_sql(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '{p}')" for k, p in patterns.items())


_ZONE = "(['quarantine', 'raw', 'curated', 'features', 'serving'])[({} % 5 + 1)::INT]"
ORACLE = {
    "source_admission": "WITH s AS (SELECT source, concat_ws(',', " + ", ".join(f"CASE WHEN md5(source)[{k}] <= '2' THEN '{f}' END" for k, f in enumerate(FIELDS, start=1)) + ") AS missing, count(*)::BIGINT AS documents FROM documents GROUP BY source) SELECT source, documents, missing FROM s WHERE missing <> ''",
    "zone_transitions": f"WITH k AS (SELECT o_custkey, o_orderdate, o_orderkey, sum(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), m AS (SELECT o_custkey, {_ZONE.format('k')} AS to_zone, coalesce({_ZONE.format('lag(k) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)')}, 'quarantine') AS from_zone FROM k) SELECT from_zone, to_zone, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS objects FROM m WHERE (from_zone, to_zone) NOT IN (('quarantine', 'raw'), ('raw', 'curated'), ('curated', 'features'), ('features', 'serving')) GROUP BY ALL",
    "schema_quarantine": "WITH r AS (SELECT CASE l_partkey % 50 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN '12x' ELSE l_quantity::INT::VARCHAR END AS raw FROM lineitem), c AS (SELECT raw, try_cast(raw AS INT) AS value FROM r) SELECT CASE WHEN value IS NULL THEN 'quarantine' ELSE 'accepted' END AS state, CASE WHEN value IS NULL THEN raw END AS text, count(*)::BIGINT AS n, sum(value)::BIGINT AS total FROM c GROUP BY 1, 2",
    "dq_referential": "SELECT l_orderkey, count(*)::BIGINT AS orphans FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0) o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL GROUP BY 1",
    "dq_timeliness": f"WITH {OBSERVATIONS}, h AS (SELECT revision, date_diff('microsecond', observed_at, available_at) / 3.6e9 AS hours FROM obs) SELECT revision, quantile_cont(hours, 0.5) AS median, quantile_cont(hours, 0.95) AS p95, max(hours) AS longest, round(avg(CASE WHEN hours > 24 THEN 1.0::DOUBLE ELSE 0 END), 6) AS late FROM h GROUP BY 1",
    "drift_ks": "WITH v AS (SELECT value, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1), c AS (SELECT sum(a) OVER w / (SELECT sum(a) FROM v)::DOUBLE AS fa, sum(b) OVER w / (SELECT sum(b) FROM v)::DOUBLE AS fb FROM v WINDOW w AS (ORDER BY value)) SELECT round(max(abs(fa - fb)), 6) AS ks, count(*)::BIGINT AS different FROM c",
    "cross_source_conflict": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT event_type)::BIGINT AS sources, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1 AND min(value) <> max(value)",
    "claim_span_check": "SELECT doc_id, substring(text, (doc_id % 20 + 1), 15) = substring(text, (doc_id % 20 + 1 + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END), 15) AS holds FROM documents",
    "claim_corroboration": r"WITH s AS (SELECT source, trim(unnest(regexp_split_to_array(text, '[.!?\n]+')), ' ') AS claim FROM documents) SELECT md5(claim) AS claim, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS n, count(DISTINCT source) >= 2 AS promoted FROM s WHERE claim <> '' GROUP BY 1",
    "claim_validity": "SELECT event_id, user_id, ts + to_days((event_id % 10 + 1)::INT) AS expires_at FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND ts + to_days((event_id % 10 + 1)::INT) > TIMESTAMP '2024-01-15' AND value >= 50",
    "collection_failures": "WITH d AS (SELECT day::INT AS day, source FROM (SELECT unnest(range(min(k), max(k) + 1)) AS day FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS k FROM events) k) t, (SELECT DISTINCT event_type AS source FROM events) s), g AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS day, event_type AS source, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND date_diff('day', DATE '2024-01-01', ts::DATE) % 6 = 0) GROUP BY ALL) SELECT d.day, d.source, CASE WHEN n IS NULL THEN 'failed' ELSE 'collected' END AS status, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN g ON g.day = d.day AND g.source = d.source",
    "deletion_effect": "WITH c AS (SELECT c_custkey AS k, c_acctbal < 0 AS gone FROM customer), z AS (SELECT 'raw' AS zone, k, gone, NOT gone AS kept FROM c UNION ALL SELECT 'curated', k, gone, NOT gone FROM orders JOIN c ON o_custkey = k UNION ALL SELECT 'features', k, gone, NOT (gone AND k % 2 = 0) AND k % 50 <> 7 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = k) SELECT zone, count(*)::BIGINT AS before, count(*) FILTER (kept)::BIGINT AS after, count(*) FILTER (kept AND gone)::BIGINT AS left_over, count(*) FILTER (NOT kept AND NOT gone)::BIGINT AS lost FROM z GROUP BY zone",
    "lineage_closure": "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS snapshot, unnest([p_partkey // 2, p_partkey // 3]) AS upstream FROM part WHERE p_partkey > 0), c AS (SELECT snapshot, upstream, 1::BIGINT AS depth FROM e UNION SELECT c.snapshot, e.upstream, c.depth + 1 FROM c JOIN e ON e.snapshot = c.upstream) SELECT snapshot, upstream, min(depth)::BIGINT AS depth FROM c GROUP BY ALL",
    "secret_scan": _scan_sql(SECRETS),
    "pii_scan": _scan_sql(PERSONAL),
    "card_completeness": "SELECT n_name AS card, concat_ws(',', " + ", ".join(f"CASE WHEN (n_nationkey + {k}) % 5 = 0 THEN '{s}' END" for k, s in enumerate(SECTIONS)) + ") AS missing, " + " + ".join(f"CASE WHEN (n_nationkey + {k}) % 5 = 0 THEN 1::BIGINT ELSE 0 END" for k in range(len(SECTIONS))) + " AS n_missing, false AS complete FROM nation",
}
ORACLE["card_completeness"] = ORACLE["card_completeness"].replace("false AS complete", "NOT (" + " OR ".join(f"(n_nationkey + {k}) % 5 = 0" for k in range(len(SECTIONS))) + ") AS complete")
