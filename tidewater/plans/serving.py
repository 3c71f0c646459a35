"""Serving, audit and promotion over the driver's tables; faults to be found are planted by a rule that the docstring names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, ordering, rules
from ..session import table
from .evidence import FORECASTS, forecasts


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def prediction_bundle(spark, sf_dir):
    """One response for each user: the latest forecast, its run and the three latest events as evidence, in order."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = forecasts(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 3")  # bounded before it is collected
    found = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("r", "event_id", "p", "ts"))).alias("e"))
    evidence = F.array_join(F.transform("e", lambda x: x.event_id.cast("string")), "|")
    return found.select("user_id", F.md5(F.concat_ws(":", F.lit("run"), "user_id", evidence)).alias("run_id"), F.round(F.col("e")[0].p, 9).alias("p"), F.col("e")[0].ts.alias("generated_from"), evidence.alias("evidence"), F.lit("unapproved").alias("state"))


PROPOSAL = [("not unapproved", "state", "required", None), ("not unapproved", "state", "equals", "unapproved"), ("no objective", "objective", "required", None), ("no alternative", "alternative", "required", None)]


def proposal_schema_check(spark, sf_dir):
    """Proposals (orders) that break their schema: finished ones (status F) began as approved, every 17th has no objective, every 19th no alternative."""
    key = F.col("o_orderkey")
    proposals = table(spark, sf_dir, "orders").select(key.alias("proposal_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("unapproved").alias("state"), F.when(key % 17 != 0, "points").alias("objective"), F.when(key % 19 != 0, "hold").alias("alternative"))
    return rules.first_broken(proposals, PROPOSAL).filter("problem is not null").select("proposal_id", "problem")


def transcript_order(spark, sf_dir):
    """Gaps and repeated roles in transcripts: every fourth conversation lost its third turn, in the next one the first two turns have one role."""
    k = F.col("conv_id") % 4
    own = table(spark, sf_dir, "conversations").filter(~((k == 0) & (F.col("turn") == 2))).withColumn("role", F.when((k == 1) & (F.col("turn") < 2), "user").otherwise(F.col("role")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    found = own.select("conv_id", "turn", "role", F.when(F.col("turn") != F.lag("turn").over(w) + 1, "gap").when(F.col("role") == F.lag("role").over(w), "same role").alias("problem"))
    return found.filter("problem is not null")


def audit_completeness(spark, sf_dir):
    """Audit rows (events) by the fields they lack: the actor in every ninth, the approval in every 14th, the version in every 21st."""
    fields = {"actor": 9, "approval": 14, "version": 21}
    rows = _events(spark, sf_dir).select("event_id", *[F.when(F.col("event_id") % n != 0, F.lit(f"{f} 1")).alias(f) for f, n in fields.items()])
    found = rules.broken(rows, [(f, f, "required", None) for f in fields])
    return found.groupBy(F.array_join("broken", ",").alias("missing")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def provenance_record(spark, sf_dir):
    """Operation, latency, outcome and the digest of the answer for each assistant turn."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return own.select("conv_id", "turn", F.concat_ws("-", F.lit("answer"), "conv_id", "turn").alias("operation"), (F.length("text") % 100).cast("long").alias("latency_ms"), F.when(F.length("text") > 0, "ok").otherwise("empty").alias("outcome"), F.sha2("text", 256).alias("response_sha256"))


def allowlist_violations(spark, sf_dir):
    """Uses of tools (types) that the list of allowed ones lacks; nothing stands in for them."""
    allowed = spark.createDataFrame([("click",), ("view",), ("signup",)], "event_type string")
    return _events(spark, sf_dir).join(F.broadcast(allowed), "event_type", "left_anti").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


TOKEN = [
    ("issuer", "iss", "required", None), ("issuer", "iss", "one_of", "issuer-0, issuer-1"), ("audience", "aud", "required", None), ("audience", "aud", "one_of", "view, click, purchase"),
    ("expiry", "left", "required", None), ("expiry", "left", "at_least", "2"), ("scope", "scope", "required", None), ("scope", "scope", "at_least", "50"),
]


def token_policy(spark, sf_dir):
    """Tokens (events) are refused unless issuer, audience, expiry and scope all hold; the first that fails is the reason."""
    tokens = _events(spark, sf_dir).select("event_id", F.concat(F.lit("issuer-"), F.col("user_id") % 3).alias("iss"), F.col("event_type").alias("aud"), (F.col("event_id") % 5).alias("left"), F.get_json_object("props", "$.k").alias("scope"))
    return rules.first_broken(tokens, TOKEN, "refused").select("event_id", F.coalesce("refused", F.lit("allowed")).alias("decision"))


def citation_support(spark, sf_dir):
    """Share of an answer's different words that the user's turns of the conversation hold."""
    words = lambda role: table(spark, sf_dir, "conversations").filter(F.col("role") == role).select("conv_id", F.explode(F.array_distinct(F.array_remove(F.split(F.lower("text"), "[ \t\n\r]+"), ""))).alias("word")).distinct()
    found = words("assistant").join(words("user").withColumn("known", F.lit(1)), ["conv_id", "word"], "left")
    return found.groupBy("conv_id").agg(F.count("*").alias("claims"), F.count("known").alias("supported"), F.round(F.count("known") / F.count("*"), 6).alias("share"))


def promotion_gate(spark, sf_dir):
    """Models (users by their last digit) are promoted if all seven conditions hold."""
    f = forecasts(spark, sf_dir).withColumn("model", F.col("user_id") % 10)
    p, y = F.col("p"), F.col("y")
    each = f.groupBy("model").agg(F.count("*").alias("n"), metrics.brier(p, y).alias("brier"), F.abs(F.avg(p) - F.avg(y)).alias("bias"), metrics.log_loss(p, y).alias("loss"), F.count_distinct(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7)).alias("weeks"), F.count_distinct("user_id").alias("users"))
    whole = f.agg(metrics.brier(p, y).alias("incumbent"))
    conditions = [F.col("n") >= 50, F.col("brier") < 0.25, F.col("bias") < 0.05, F.col("loss") < 0.7, F.col("weeks") >= 4, F.col("users") >= 2, F.col("brier") <= F.col("incumbent")]
    met = sum((c.cast("long") for c in conditions[1:]), conditions[0].cast("long"))
    return each.crossJoin(F.broadcast(whole)).select("model", met.alias("met"), (met == len(conditions)).alias("promote"))


def shadow_monitor(spark, sf_dir):
    """Calibration of a model in shadow over the last seven days; where it is off by more than 0.03 the incumbent comes back."""
    f = forecasts(spark, sf_dir)
    daily = f.groupBy((F.col("user_id") % 4).alias("model"), F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.sum(F.col("p") - F.col("y")).alias("off"), F.count("*").alias("n"))
    w = Window.partitionBy("model").orderBy("day").rangeBetween(-6, 0)
    bias = F.round(F.sum("off").over(w) / F.sum("n").over(w), 6)
    return daily.select("model", "day", bias.alias("bias"), F.when(F.abs(bias) > 0.03, "rollback").otherwise("keep").alias("action"))


def registration_order(spark, sf_dir):
    """Experiments (orders) whose final test was unlocked (first shipment) before they were registered."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("unlocked_at"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey").filter("o_orderdate >= unlocked_at").select(F.col("o_orderkey").alias("experiment"), F.col("o_orderdate").alias("registered_at"), "unlocked_at")


EXCEPTION = [("no owner", "owner", "required", None), ("no link", "link", "required", None), ("expired", "until", "required", None), ("expired", "until", "after", "2024-06-01")]


def exception_validity(spark, sf_dir):
    """Exceptions (suppliers) without an owner (every seventh), without a link (every eleventh) or expired by June 2024 (they last 1 to 400 days)."""
    until = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 400 + 1).cast("int"))
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key.alias("exception_id"), F.when(key % 7 != 0, "someone").alias("owner"), F.when(key % 11 != 0, "#1").alias("link"), until.alias("until"))
    return rules.first_broken(rows, EXCEPTION).filter("problem is not null").select("exception_id", "problem")


def bench_record(spark, sf_dir):
    """Claims on speed (types of event as claims, their values as times) with all that a claim has to carry; one on fewer than 20 runs isn't complete."""
    own = _events(spark, sf_dir).groupBy(F.col("event_type").alias("claim"), (F.col("user_id") % 3).alias("machine"))
    found = own.agg(F.count("*").alias("repetitions"), F.percentile("value", 0.5).alias("median"), F.round(F.stddev_samp("value"), 6).alias("deviation"), F.min("value").alias("fastest"))
    return found.withColumn("complete", F.col("repetitions") >= 20)


def league_rank(spark, sf_dir):
    """Place of each user by total value, by ranges of totals, not in one task."""
    totals = _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return ordering.ranked(totals, "total").select("user_id", "total", "place")


QUERIES = {f.__name__: f for f in (prediction_bundle, proposal_schema_check, transcript_order, audit_completeness, provenance_record, allowlist_violations, token_policy, citation_support, promotion_gate, shadow_monitor, registration_order, exception_validity, bench_record, league_rank)}

_WORDS = "SELECT DISTINCT conv_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS word FROM conversations WHERE role = '{}'"
ORACLE = {
    "prediction_bundle": f"WITH {FORECASTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM f), g AS (SELECT user_id, string_agg(event_id::VARCHAR, '|' ORDER BY r) AS evidence, max(p) FILTER (r = 1) AS p, max(ts) AS generated_from FROM r WHERE r <= 3 GROUP BY 1) SELECT user_id, md5('run:' || user_id || ':' || evidence) AS run_id, round(p, 9) AS p, generated_from, evidence, 'unapproved' AS state FROM g",
    "proposal_schema_check": "SELECT o_orderkey AS proposal_id, CASE WHEN o_orderstatus = 'F' THEN 'not unapproved' WHEN o_orderkey % 17 = 0 THEN 'no objective' ELSE 'no alternative' END AS problem FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0",
    "transcript_order": "WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn < 2 THEN 'user' ELSE role END AS role FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn = 2)), l AS (SELECT *, lag(turn) OVER w AS a, lag(role) OVER w AS b FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, CASE WHEN turn <> a + 1 THEN 'gap' ELSE 'same role' END AS problem FROM l WHERE turn <> a + 1 OR role = b",
    "audit_completeness": "SELECT concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'actor' END, CASE WHEN event_id % 14 = 0 THEN 'approval' END, CASE WHEN event_id % 21 = 0 THEN 'version' END) AS missing, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY 1",
    "provenance_record": "SELECT conv_id, turn, 'answer-' || conv_id || '-' || turn AS operation, (length(text) % 100)::BIGINT AS latency_ms, CASE WHEN text <> '' THEN 'ok' ELSE 'empty' END AS outcome, sha256(text) AS response_sha256 FROM conversations WHERE role = 'assistant'",
    "allowlist_violations": "SELECT event_type, user_id, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY ALL",
    "token_policy": "SELECT event_id, CASE WHEN user_id % 3 = 2 THEN 'issuer' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'audience' WHEN event_id % 5 < 2 THEN 'expiry' WHEN coalesce((props ->> '$.k')::INT < 50, true) THEN 'scope' ELSE 'allowed' END AS decision FROM events",
    "citation_support": f"WITH a AS ({_WORDS.format('assistant')}), u AS ({_WORDS.format('user')}) SELECT a.conv_id, count(*)::BIGINT AS claims, count(u.word)::BIGINT AS supported, round(count(u.word) / count(*)::DOUBLE, 6) AS share FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.word = a.word GROUP BY 1",
    "promotion_gate": f"WITH {FORECASTS}, e AS (SELECT user_id % 10 AS model, count(*) AS n, avg((p - y) * (p - y)) AS brier, abs(avg(p) - avg(y)) AS bias, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS loss, count(DISTINCT floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7.0)) AS weeks, count(DISTINCT user_id) AS users FROM f GROUP BY 1), m AS (SELECT model, (n >= 50)::BIGINT + (brier < 0.25)::BIGINT + (bias < 0.05)::BIGINT + (loss < 0.7)::BIGINT + (weeks >= 4)::BIGINT + (users >= 2)::BIGINT + (brier <= (SELECT avg((p - y) * (p - y)) FROM f))::BIGINT AS met FROM e) SELECT model, met, met = 7 AS promote FROM m",
    "shadow_monitor": f"WITH {FORECASTS}, d AS (SELECT user_id % 4 AS model, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, sum(p - y) AS off, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT model, day, round(sum(off) OVER w / sum(n) OVER w, 6) AS bias FROM d WINDOW w AS (PARTITION BY model ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT model, day, bias, CASE WHEN abs(bias) > 0.03 THEN 'rollback' ELSE 'keep' END AS action FROM b",
    "registration_order": "SELECT o_orderkey AS experiment, o_orderdate AS registered_at, min(l_shipdate) AS unlocked_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING o_orderdate >= min(l_shipdate)",
    "exception_validity": "SELECT s_suppkey AS exception_id, CASE WHEN s_suppkey % 7 = 0 THEN 'no owner' WHEN s_suppkey % 11 = 0 THEN 'no link' ELSE 'expired' END AS problem FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR DATE '2024-01-01' + (s_suppkey % 400 + 1)::INT < DATE '2024-06-01'",
    "bench_record": "SELECT event_type AS claim, user_id % 3 AS machine, count(*)::BIGINT AS repetitions, quantile_cont(value, 0.5) AS median, round(stddev_samp(value), 6) AS deviation, min(value) AS fastest, count(*) >= 20 AS complete FROM events GROUP BY 1, 2",
    "league_rank": "SELECT user_id, round(total, 4) AS total, CAST(rank() OVER (ORDER BY round(total, 4) DESC) AS BIGINT) AS place FROM (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id) x",
}
