"""Validity in time, baselines, decision metrics and selection of models, over the driver's tables.

The forecasts and observations are those of ``evidence``; what else a query
derives by rule is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decision, metrics, ordering, temporal
from ..session import table
from .evidence import FORECASTS, WEEKS_SQL, forecasts, whole_weeks

START = "2024-01-01 00:00:00"


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _week():
    return F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int")


def entity_valid_at(spark, sf_dir):
    """Identifiers of a user change weekly for as many whole weeks as the table has; an event carries the one that was valid at its time, or none."""
    users = _events(spark, sf_dir).select("user_id").distinct()
    weeks = _events(spark, sf_dir).agg(F.floor((F.datediff(F.max("ts"), F.lit("2024-01-01")) + 1) / 7).cast("int").alias("n"))
    week = F.make_dt_interval(F.col("k") * 7)
    ids = users.crossJoin(F.broadcast(weeks)).filter("n > 0").select("user_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(
        "user_id", (F.col("user_id") * 100 + F.col("k")).alias("code"), (_ntz(START) + week).alias("valid_from"), (_ntz(START) + week + F.make_dt_interval(F.lit(7))).alias("valid_to")
    )
    return temporal.valid_at(_events(spark, sf_dir), ids, ["user_id"], "ts").select("event_id", "code")


def temporal_split_check(spark, sf_dir):
    """A split supports a claim about time only if all of its training is before all of its test."""
    splits = {"by_id": F.col("event_id") % 5 == 0, "by_time": F.col("ts") >= _ntz("2024-01-20 00:00:00")}
    rows = _events(spark, sf_dir).select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("split"), c.alias("test")) for n, c in splits.items()])).alias("s")).select("ts", "s.*")
    bounds = rows.groupBy("split").agg(F.max(F.when(~F.col("test"), F.col("ts"))).alias("train_to"), F.min(F.when(F.col("test"), F.col("ts"))).alias("test_from"))
    return bounds.withColumn("supports", F.col("train_to") < F.col("test_from"))


def final_test_unlock_audit(spark, sf_dir):
    """Experiments (customers) whose final test was unlocked (urgent orders) more than once."""
    unlocks = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return unlocks.groupBy(F.col("o_custkey").alias("experiment")).agg(F.count("*").alias("unlocks"), F.min("o_orderdate").alias("first")).filter("unlocks > 1")


def contamination_ngram(spark, sf_dir):
    """Documents that share runs of eight words with benchmark items, and how many different ones."""
    grams = lambda frame, key: decision.word_grams(frame, key, "text", 8)
    items = grams(table(spark, sf_dir, "benchmark"), "item_id").select("gram").distinct()
    return grams(table(spark, sf_dir, "documents"), "doc_id").join(items, "gram").groupBy("doc_id").agg(F.count("*").alias("grams"))


def baseline_crowd(spark, sf_dir):
    """The crowd's mean of each type before the cutoff as forecast of all later values."""
    late = F.col("ts") >= _ntz("2024-01-20 00:00:00")
    crowd = _events(spark, sf_dir).filter(~late).groupBy("event_type").agg(F.avg("value").alias("crowd"))
    later = _events(spark, sf_dir).filter(late).join(F.broadcast(crowd), "event_type")  # a row for each type
    return later.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("crowd"))), 6).alias("mae"))


def incumbent_compare(spark, sf_dir):
    """Weekly Brier scores of the incumbent (all past events) and a challenger (the last ten)."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, -1)
    f = forecasts(spark, sf_dir)
    f = f.withColumn("q", (1 + F.coalesce(F.sum("y").over(past), F.lit(0.0))) / (5 + F.count("*").over(past)))
    found = f.groupBy(_week().alias("week")).agg(F.count("*").alias("n"), F.round(metrics.brier(F.col("p"), F.col("y")), 6).alias("incumbent"), F.round(metrics.brier(F.col("q"), F.col("y")), 6).alias("challenger"))
    return found.withColumn("better", F.col("challenger") < F.col("incumbent"))


def log_score(spark, sf_dir):
    """Mean -ln of the mass that a user's own past puts on the bin (of ten) of the next value; half a count in each bin before any."""
    bins = F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int")
    order = ["ts", "event_id"]
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = _events(spark, sf_dir).withColumn("bin", bins)
    mass = (F.count("*").over(before("user_id", "bin")) + 0.5) / (F.count("*").over(before("user_id")) + 5.0)
    return own.select("event_type", mass.alias("mass")).groupBy("event_type").agg(F.round(F.avg(-F.ln("mass")), 6).alias("log_score"), F.count("*").alias("n"))


def rank_metrics(spark, sf_dir):
    """Spearman's correlation and precision in the first ten of users ranked by their first and second half."""
    half = F.col("ts") >= _ntz("2024-01-16 00:00:00")
    totals = _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.when(~half, F.col("value"))), F.lit(0.0)), 4).alias("guess"), F.round(F.coalesce(F.sum(F.when(half, F.col("value"))), F.lit(0.0)), 4).alias("real"))
    both = ordering.ranked(ordering.ranked(totals, "guess", "a"), "real", "b")
    first = F.col("a") <= 10
    return both.agg(F.round(F.corr("a", "b"), 6).alias("spearman"), F.round(F.count_if(first & (F.col("b") <= 10)) / F.count_if(first), 6).alias("precision_at_10"), F.count("*").alias("n"))


def realised_value(spark, sf_dir):
    """What followed each decision (purchase) within three days: number and sum of the user's other events."""
    ahead = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '0 00:00:00.000001' DAY TO SECOND FOLLOWING AND INTERVAL '3 00:00:00' DAY TO SECOND FOLLOWING)"
    other = "CASE WHEN event_type <> 'purchase' THEN {} END"
    own = _events(spark, sf_dir).selectExpr("event_id AS decision_id", "event_type", f"count({other.format(1)}) {ahead} AS n", f"round(coalesce(sum({other.format('value')}) {ahead}, 0), 4) AS realised")
    return own.filter("event_type = 'purchase'").drop("event_type")


def regret(spark, sf_dir):
    """Each week the type with the best mean of the week before is chosen; regret is what the best of the types known then would have given over it."""
    weekly = _events(spark, sf_dir).groupBy(_week().alias("week"), "event_type").agg(F.avg("value").alias("mean"))
    options = weekly.alias("now").join(weekly.alias("last"), (F.col("now.week") == F.col("last.week") + 1) & (F.col("now.event_type") == F.col("last.event_type")))
    return decision.regret(options.select("now.week", F.col("now.event_type").alias("option"), F.col("last.mean").alias("expected"), F.col("now.mean").alias("realised")), "week")


def switch_penalty_utility(spark, sf_dir):
    """A user's values less four for each change of type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = _events(spark, sf_dir).withColumn("switch", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(0)))
    return own.groupBy("user_id").agg(F.round(F.sum(F.col("value") - 4 * F.col("switch")), 4).alias("utility"), F.sum("switch").alias("switches"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squads by rule: all parts, in five squads."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("squad"), "p_partkey", "p_brand", "p_type", F.round(F.col("p_retailprice") * 10).cast("long").alias("tenths"))


CONSTRAINTS = [("v1", "brand", "Brand#1", 0, 0), ("v1", "brand", "Brand#2", 1, 2), ("v1", "type", "SMALL", 3, 4), ("v1", "type", "ECONOMY", 0, 500), ("v1", "type", "NOT THERE", 1, 9), ("v1", "price", "all", 0, 60000)]


def constraint_violations(spark, sf_dir):
    """Rules (invented) that squads break; a group that a squad lacks counts as zero."""
    rules = spark.createDataFrame(CONSTRAINTS, "rule_version string, kind string, grp string, lo long, hi long")
    own = picks(spark, sf_dir)
    facts = F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("grp"), F.lit(1).cast("long").alias("x")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("grp"), F.lit(1).cast("long").alias("x")), F.struct(F.lit("price").alias("kind"), F.lit("all").alias("grp"), F.col("tenths").alias("x"))))
    return decision.broken_rules(own.select("squad", facts.alias("f")).select("squad", "f.*"), rules, "squad")


def metric_inputs_pit(spark, sf_dir):
    """Inputs of a decision metric that were not there at the decision: here half of the purchases wrongly use the event after theirs."""
    used = F.col("event_id") + F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    own = _events(spark, sf_dir)
    asked = own.filter("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("ts").alias("deadline"), used.alias("input_id"))
    told = own.select(F.col("event_id").alias("input_id"), F.col("ts").alias("available_at"))
    return asked.join(told, "input_id").filter("available_at > deadline").select("decision_id", "input_id")


def run_registry_gaps(spark, sf_dir):
    """Runs that a registry should have by its numbers but lacks: of the runs (orders) of experiments (customers) every tenth was not recorded."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment"), "o_orderkey", F.row_number().over(w).cast("long").alias("run")).filter("o_orderkey % 10 <> 3")
    return decision.gaps(runs, "experiment", "run")


def seed_median(spark, sf_dir):
    """Scores by seed: the median is reported, and how far the best seed lies above it."""
    by_seed = _events(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 5).alias("seed")).agg(F.avg("value").alias("score"))
    found = by_seed.groupBy("user_id").agg(F.percentile("score", 0.5).alias("median"), F.max("score").alias("best"), F.count("*").alias("seeds"))
    return found.select("user_id", F.round("median", 6).alias("median"), F.round(F.col("best") - F.col("median"), 6).alias("optimism"), "seeds")


def nested_folds(spark, sf_dir):
    """Inner folds inside the training part of each outer fold."""
    folds = temporal.nested_bounds(spark, START, 7, whole_weeks(spark, sf_dir) - 1)
    rows = _events(spark, sf_dir).select("event_id", "ts", "value")
    found = rows.join(F.broadcast(folds), F.col("ts") < F.col("valid_to")).withColumn("part", F.when(F.col("ts") >= F.col("valid_from"), "validation").otherwise("train"))
    return found.groupBy("outer", "inner", "part").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))


def one_se_rule(spark, sf_dir):
    """Means of the last 1, 3, 5 or 10 values as models: the simplest (shortest) one within a standard error of the best."""
    w = lambda n: Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-n, -1)
    own = _events(spark, sf_dir).select("value", *[F.avg("value").over(w(n)).alias(f"m{n}") for n in (1, 3, 5, 10)])
    errors = own.select(F.explode(F.array(*[F.struct(F.lit(n).alias("complexity"), ((F.col("value") - F.col(f"m{n}")) ** 2).alias("error")) for n in (1, 3, 5, 10)])).alias("e")).select("e.*").filter("error is not null")
    found = errors.groupBy("complexity").agg(F.avg("error").alias("mean"), (F.stddev_samp("error") / F.sqrt(F.count("error"))).alias("se"))
    return decision.simplest(found).select("complexity", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), "chosen")


QUERIES = {f.__name__: f for f in (entity_valid_at, temporal_split_check, final_test_unlock_audit, contamination_ngram, baseline_crowd, incumbent_compare, log_score, rank_metrics, realised_value, regret, switch_penalty_utility, constraint_violations, metric_inputs_pit, run_registry_gaps, seed_median, nested_folds, one_se_rule)}

_W = "CAST(floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7.0) AS INT)"
_GRAMS = """SELECT DISTINCT {key}, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 6)) AS i FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM {table}) x) y"""
_PAST10 = "(1.0 + coalesce(sum(y) OVER v, 0)) / (5.0 + count(*) OVER v) AS q"
ORACLE = {
    "entity_valid_at": "WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, user_id * 100 + k AS code, TIMESTAMP '2024-01-01' + to_days((7 * k)::INT) AS a, TIMESTAMP '2024-01-01' + to_days((7 * k + 7)::INT) AS b FROM u, (SELECT unnest(range((date_diff('day', DATE '2024-01-01', max(ts)::DATE) + 1) // 7)) AS k FROM events) t) SELECT event_id, code FROM events e LEFT JOIN m ON m.user_id = e.user_id AND ts >= a AND ts < b",
    "temporal_split_check": "WITH s AS (SELECT 'by_id' AS split, ts, event_id % 5 = 0 AS test FROM events UNION ALL SELECT 'by_time', ts, ts >= TIMESTAMP '2024-01-20' FROM events) SELECT split, max(ts) FILTER (NOT test) AS train_to, min(ts) FILTER (test) AS test_from, max(ts) FILTER (NOT test) < min(ts) FILTER (test) AS supports FROM s GROUP BY split",
    "final_test_unlock_audit": "SELECT o_custkey AS experiment, count(*)::BIGINT AS unlocks, min(o_orderdate) AS first FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1",
    "contamination_ngram": f"WITH d AS ({_GRAMS.format(key='doc_id', table='documents')}), b AS ({_GRAMS.format(key='item_id', table='benchmark')}) SELECT doc_id, count(*)::BIGINT AS grams FROM d WHERE gram IN (SELECT gram FROM b) GROUP BY doc_id",
    "baseline_crowd": "WITH c AS (SELECT event_type, avg(value) AS crowd FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT event_type, count(*)::BIGINT AS n, round(avg(abs(value - crowd)), 6) AS mae FROM events JOIN c USING (event_type) WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1",
    "incumbent_compare": f"WITH {FORECASTS}, g AS (SELECT *, {_PAST10} FROM f WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), s AS (SELECT {_W} AS week, count(*)::BIGINT AS n, round(avg((p - y) * (p - y)), 6) AS incumbent, round(avg((q - y) * (q - y)), 6) AS challenger FROM g GROUP BY 1) SELECT *, challenger < incumbent AS better FROM s",
    "log_score": "WITH b AS (SELECT *, least(floor(value / 10), 9) AS bin FROM events), m AS (SELECT event_type, (count(*) OVER (PARTITION BY user_id, bin ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5::DOUBLE) / (count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5) AS mass FROM b) SELECT event_type, round(avg(-ln(mass)), 6) AS log_score, count(*)::BIGINT AS n FROM m GROUP BY 1",
    "rank_metrics": "WITH t AS (SELECT user_id, round(coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-16'), 0), 4) AS guess, round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 0), 4) AS real_ FROM events GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY guess DESC) AS a, rank() OVER (ORDER BY real_ DESC) AS b FROM t) SELECT round(corr(a, b), 6) AS spearman, round(count(*) FILTER (a <= 10 AND b <= 10) / count(*) FILTER (a <= 10)::DOUBLE, 6) AS precision_at_10, count(*)::BIGINT AS n FROM r",
    "realised_value": "SELECT d.event_id AS decision_id, count(o.event_id)::BIGINT AS n, round(coalesce(sum(o.value), 0), 4) AS realised FROM events d LEFT JOIN events o ON o.user_id = d.user_id AND o.event_type <> 'purchase' AND o.ts > d.ts AND o.ts <= d.ts + INTERVAL 3 DAY WHERE d.event_type = 'purchase' GROUP BY d.event_id",
    "regret": f"WITH w AS (SELECT {_W} AS week, event_type, avg(value) AS mean FROM events GROUP BY ALL), o AS (SELECT a.week, a.event_type, b.mean AS expected, a.mean AS realised FROM w a JOIN w b ON b.week = a.week - 1 AND b.event_type = a.event_type) SELECT week, arg_max(event_type, expected) AS chosen, round(max(realised) - arg_max(realised, expected), 6) AS regret, count(*)::BIGINT AS options FROM o GROUP BY week",
    "switch_penalty_utility": "WITH s AS (SELECT user_id, value, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS switch FROM events) SELECT user_id, round(sum(value - 4 * switch), 4) AS utility, sum(switch)::BIGINT AS switches FROM s GROUP BY 1",
    "constraint_violations": "WITH k(rule_version, kind, grp, lo, hi) AS (VALUES " + ", ".join(map(str, CONSTRAINTS)) + "), p AS (SELECT p_partkey % 5 AS squad, * FROM part), a AS (SELECT squad, 'brand' AS kind, p_brand AS grp, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT squad, 'type', p_type, count(*) FROM p GROUP BY ALL UNION ALL SELECT squad, 'price', 'all', sum(round(p_retailprice * 10)::BIGINT) FROM p GROUP BY ALL), s AS (SELECT DISTINCT squad FROM p) SELECT s.squad, k.rule_version, k.kind, k.grp, coalesce(n, 0)::BIGINT AS actual, lo::BIGINT AS lo, hi::BIGINT AS hi FROM s CROSS JOIN k LEFT JOIN a ON a.squad = s.squad AND a.kind = k.kind AND a.grp = k.grp WHERE coalesce(n, 0) < lo OR coalesce(n, 0) > hi",
    "metric_inputs_pit": "SELECT d.event_id AS decision_id, o.event_id AS input_id FROM events d JOIN events o ON o.event_id = d.event_id + CASE WHEN d.event_id % 2 = 0 THEN 1 ELSE -1 END WHERE d.event_type = 'purchase' AND o.ts > d.ts",
    "run_registry_gaps": "WITH r AS (SELECT o_custkey AS experiment, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders), k AS (SELECT * FROM r WHERE o_orderkey % 10 <> 3), m AS (SELECT experiment, unnest(range(1, max(run) + 1)) AS run FROM k GROUP BY experiment) SELECT experiment, run::BIGINT AS run FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.experiment = m.experiment AND k.run = m.run)",
    "seed_median": "WITH s AS (SELECT user_id, event_id % 5 AS seed, avg(value) AS score FROM events GROUP BY ALL) SELECT user_id, round(quantile_cont(score, 0.5), 6) AS median, round(max(score) - quantile_cont(score, 0.5), 6) AS optimism, count(*)::BIGINT AS seeds FROM s GROUP BY 1",
    "nested_folds": "WITH b AS (SELECT o::INT AS outer_, i::INT AS inner_, TIMESTAMP '2024-01-01' + to_days((7 * i)::INT) AS a, TIMESTAMP '2024-01-01' + to_days((7 * i + 7)::INT) AS z FROM (SELECT unnest(range(2, WEEKS)) AS o) x, (SELECT unnest(range(1, WEEKS - 1)) AS i) y WHERE i < o) SELECT outer_ AS outer, inner_ AS inner, CASE WHEN ts >= a THEN 'validation' ELSE 'train' END AS part, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(ts) AS last FROM events JOIN b ON ts < z GROUP BY ALL".replace("WEEKS", WEEKS_SQL).replace(" AS outer,", ' AS "outer",').replace(" AS inner,", ' AS "inner",'),
    "one_se_rule": "WITH m AS (SELECT value, " + ", ".join(f"avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS m{n}" for n in (1, 3, 5, 10)) + " FROM events), e AS (" + " UNION ALL ".join(f"SELECT {n} AS complexity, (value - m{n}) * (value - m{n}) AS error FROM m WHERE m{n} IS NOT NULL" for n in (1, 3, 5, 10)) + "), s AS (SELECT complexity, avg(error) AS mean, stddev_samp(error) / sqrt(count(*)) AS se FROM e GROUP BY 1), b AS (SELECT min(complexity) AS c FROM s WHERE mean <= (SELECT min(mean) + arg_min(se, mean) FROM s)) SELECT complexity, round(mean, 4) AS mean, round(se, 4) AS se, complexity = c AS chosen FROM s, b",
}
