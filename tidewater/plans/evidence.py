"""Point-in-time, forecast and simulation queries over the driver's tables, each with its DuckDB statement.

The tables hold no revisions or forecasts; these are derived by rule.
Observations are all events but purchases, available some hours after they
happened; every tenth is corrected a day later.  Decisions are purchases.  A
forecast of an event being a purchase is (1 + past purchases) / (5 + past events)
of its user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, temporal
from ..session import table

OBSERVATIONS = """obs AS (
  SELECT event_id, user_id AS entity, ts AS observed_at, ts + to_hours(CAST(event_id % 7 AS INT)) AS available_at, 0 AS revision, value FROM events WHERE event_type <> 'purchase'
  UNION ALL SELECT event_id, user_id, ts, ts + to_hours(24 + CAST(event_id % 7 AS INT)), 1, value + 1 FROM events WHERE event_type <> 'purchase' AND event_id % 10 = 0)"""
FORECASTS = """f AS (SELECT event_id, user_id, ts, (1.0 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w, 0)) / (5.0 + count(*) OVER w) AS p, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    late = F.make_dt_interval(F.lit(0), (F.col("event_id") % 7).cast("int"))
    first = own.select("event_id", F.col("user_id").alias("entity"), F.col("ts").alias("observed_at"), (F.col("ts") + late).alias("available_at"), "value")
    told = F.struct("available_at", F.lit(0).alias("revision"), "value")
    again = F.struct((F.col("available_at") + F.expr("INTERVAL 24 HOURS")).alias("available_at"), F.lit(1).alias("revision"), (F.col("value") + 1).alias("value"))
    both = F.when(F.col("event_id") % 10 == 0, F.array(told, again)).otherwise(F.array(told))  # one scan for both
    return first.select("event_id", "entity", "observed_at", F.explode(both).alias("o")).select("event_id", "entity", "observed_at", "o.*")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("entity"), F.col("ts").alias("deadline"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", y.alias("y"))
    past = temporal.running_before(own, "user_id", "ts", ["event_id"], {"_hits": F.col("y"), "_all": F.lit(1)})
    return past.withColumn("p", (1 + F.col("_hits")) / (5 + F.col("_all"))).drop("_hits", "_all")


def asof_latest(spark, sf_dir):
    return temporal.as_of_join(decisions(spark, sf_dir), observations(spark, sf_dir), "entity", "deadline", "available_at", ["event_id", "value"], ["revision", "event_id"])


def pit_filter(spark, sf_dir):
    """Per decision the number of observations of its entity that were already available, by a running count over one sweep."""
    told = observations(spark, sf_dir).select("entity", F.col("available_at").alias("at"), F.lit(None).cast("long").alias("decision_id"), F.lit(0).alias("side"))
    asked = decisions(spark, sf_dir).select("entity", F.col("deadline").alias("at"), "decision_id", F.lit(1).alias("side"))
    both = temporal.running_before(told.unionByName(asked), "entity", "at", ["side"], {"visible": 1 - F.col("side")})
    return both.filter("side = 1").select("decision_id", F.col("visible").cast("long").alias("visible"))


def revision_as_of(spark, sf_dir):
    found = temporal.latest_revision(observations(spark, sf_dir), ["event_id"], F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return found.select("event_id", "revision", F.round("value", 6).alias("value"))


def embargo_filter(spark, sf_dir):
    own = observations(spark, sf_dir)
    cut = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return own.filter(temporal.visible(own, cut, 48)).groupBy("entity").agg(F.count("*").alias("n"), F.max("available_at").alias("latest"))


def whole_weeks(spark: SparkSession, sf_dir: str) -> int:
    """Whole weeks that the events have from the first Monday of 2024 on."""
    days = table(spark, sf_dir, "events").agg(F.datediff(F.max("ts"), F.lit("2024-01-01")).alias("d")).first().d
    return 0 if days is None else (days + 1) // 7


def _folds(expanding):
    def query(spark, sf_dir):
        folds = temporal.fold_bounds(spark, "2024-01-01 00:00:00", 7, whole_weeks(spark, sf_dir) - 1, expanding, 1)
        rows = temporal.in_folds(table(spark, sf_dir, "events").select("event_id", "ts", "value"), folds, "ts")
        return rows.groupBy("fold", "part").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))

    return query


def fold_standardise(spark, sf_dir):
    folds = temporal.fold_bounds(spark, "2024-01-01 00:00:00", 7, whole_weeks(spark, sf_dir) - 1, True, 1)
    rows = temporal.standardise_in_folds(temporal.in_folds(table(spark, sf_dir, "events").select("event_id", "ts", "value"), folds, "ts"), "value")
    return rows.filter("part = 'test'").select("fold", "event_id", F.round("z", 6).alias("z"))


def snapshot_diff(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    after = own.filter("event_id % 11 <> 0").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "edited").otherwise(F.col("event_type")))
    return temporal.snapshot_diff(own.filter("event_id % 17 <> 0"), after, "event_id", ["event_type", "user_id"])


def _score(make):
    return lambda spark, sf_dir: make(forecasts(spark, sf_dir))


def baseline_no_change(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").withColumn("last", F.lag("value").over(w))
    return own.filter("last is not null").select(F.round(F.avg(F.abs(F.col("value") - F.col("last"))), 6).alias("mae"), F.count("*").alias("n"))


def baseline_rolling_avg(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    own = table(spark, sf_dir, "events").withColumn("guess", F.avg("value").over(w))
    return own.filter("guess is not null").select(F.round(F.sqrt(F.avg((F.col("value") - F.col("guess")) ** 2)), 6).alias("rmse"), F.count("*").alias("n"))


def crps_ensemble(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, -1)
    own = table(spark, sf_dir, "events").withColumn("draws", F.collect_list("value").over(w)).filter(F.size("draws") == 8)
    return own.select("event_id", F.round(metrics.crps(F.col("draws"), F.col("value")), 9).alias("crps"))


def interval_coverage(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    own = table(spark, sf_dir, "events").select("value", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.count("*").over(w).alias("n")).filter("n = 20")
    return own.select(F.round(F.avg(F.col("value").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("coverage"), F.count("*").alias("n"))


def block_bootstrap_ci(spark, sf_dir):
    days = forecasts(spark, sf_dir).groupBy(F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.sum((F.col("p") - F.col("y")) ** 2).alias("total"), F.count("*").alias("n"))
    blocks = days.withColumn("block", F.row_number().over(Window.orderBy("day")) - 1)
    return metrics.block_bootstrap(blocks, 200, 7).select("draw", F.round("mean", 6).alias("mean"))


def holm_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("test")).agg((F.count_if(F.col("value") > 60) / F.count("*") / 10).alias("p"))
    return metrics.holm(tests).select("test", F.round("p_holm", 9).alias("p_holm"))


def mc_simulation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("draw"))
    own, shared = metrics.uniform(F.lit(1), F.col("n_nationkey"), F.col("draw")), metrics.uniform(F.lit(2), F.col("draw"))
    return n.groupBy("n_nationkey").agg(F.round(F.avg(own), 9).alias("mean"), F.round(F.avg(F.when(own + shared > 1, 1.0).otherwise(0.0)), 9).alias("joint"))


def drift_psi(spark, sf_dir):
    late = (F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))).cast("int")
    own = table(spark, sf_dir, "events").select(F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("bin"), late.alias("late"))
    bins = own.groupBy("bin").agg(F.sum(1 - F.col("late")).alias("a"), F.sum("late").alias("b"))
    share = bins.crossJoin(F.broadcast(bins.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))).select(((F.col("a") + 0.5) / (F.col("na") + 5)).alias("x"), ((F.col("b") + 0.5) / (F.col("nb") + 5)).alias("y"))
    return share.agg(F.round(F.sum((F.col("y") - F.col("x")) * F.ln(F.col("y") / F.col("x"))), 6).alias("psi"))


def sessionize_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w) >= F.expr("INTERVAL 6 HOURS")).cast("int"), F.lit(1)))
    return own.withColumn("session", F.sum("new").over(w)).groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def title_policy(spark, sf_dir):
    from ..operators.policy import valid_title

    rows = [(t,) for t in TITLES]
    return spark.createDataFrame(rows, "title string").select("title", valid_title(F.col("title")).alias("valid"))


TITLES = ["feat: add a thing", "fix(api): repair it", "docs!: rewrite all", "Feat: wrong case", "feat:missing blank", "feat: ab", "feat: abc", "research(x): not a type", "chore(a/b-c.d_e): fine one", "feat(A): bad scope", "feat: " + "x" * 95, "feat: " + "x" * 73, "feat: trailing\n", "", "ci: é is not plain", "ci: plain é is fine"]

WEEKS_SQL = "(SELECT (date_diff('day', DATE '2024-01-01', max(ts)::DATE) + 1) // 7 FROM events)"
_FOLD_SQL = """WITH b AS (SELECT CAST(k AS INT) AS fold, TIMESTAMP '2024-01-01' + to_days(7 * (CAST(k AS INT) - 1)) * {rolling} AS train_from, TIMESTAMP '2024-01-01' + to_days(7 * CAST(k AS INT) - 1) AS train_to, TIMESTAMP '2024-01-01' + to_days(7 * CAST(k AS INT)) AS test_from, TIMESTAMP '2024-01-01' + to_days(7 * CAST(k AS INT) + 7) AS test_to FROM (SELECT unnest(range(1, WEEKS)) AS k) t),
r AS (SELECT e.event_id, e.value, b.fold, CASE WHEN ts >= test_from THEN 'test' ELSE 'train' END AS part FROM events e JOIN b ON (ts >= train_from AND ts < train_to) OR (ts >= test_from AND ts < test_to))""".replace("WEEKS", WEEKS_SQL)
_FOLD_COUNT = " SELECT fold, part, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM r GROUP BY fold, part"
_U = "('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"

QUERIES = {
    "asof_latest": asof_latest,
    "pit_filter": pit_filter,
    "revision_as_of": revision_as_of,
    "embargo_filter": embargo_filter,
    "rolling_origin_folds": _folds(False),
    "expanding_folds": _folds(True),
    "fold_standardise": fold_standardise,
    "snapshot_diff": snapshot_diff,
    "beta_rate_forecast": _score(lambda f: f.select("event_id", F.round("p", 9).alias("p"))),
    "brier_score": _score(lambda f: f.agg(F.round(metrics.brier(F.col("p"), F.col("y")), 6).alias("brier"))),
    "log_loss": _score(lambda f: f.agg(F.round(metrics.log_loss(F.col("p"), F.col("y")), 6).alias("log_loss"))),
    "mae_rmse": _score(lambda f: f.agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"), F.round(F.sqrt(metrics.brier(F.col("p"), F.col("y"))), 6).alias("rmse"))),
    "calibration_slope": _score(lambda f: f.agg(F.round(F.regr_slope("y", "p"), 6).alias("slope"), F.round(F.regr_intercept("y", "p"), 6).alias("intercept"))),
    "reliability_bins": _score(metrics.reliability),
    "baseline_no_change": baseline_no_change,
    "baseline_rolling_avg": baseline_rolling_avg,
    "crps_ensemble": crps_ensemble,
    "interval_coverage": interval_coverage,
    "block_bootstrap_ci": block_bootstrap_ci,
    "holm_adjust": holm_adjust,
    "mc_simulation": mc_simulation,
    "drift_psi": drift_psi,
    "sessionize_gap": sessionize_gap,
    "json_extract": json_extract,
    "title_policy": title_policy,
}

_F = f"WITH {FORECASTS} SELECT "
ORACLE = {
    "asof_latest": f"WITH {OBSERVATIONS}, d AS (SELECT event_id AS decision_id, user_id AS entity, ts AS deadline FROM events WHERE event_type = 'purchase') SELECT decision_id, entity, deadline, event_id, value FROM (SELECT d.*, o.event_id, o.value, row_number() OVER (PARTITION BY decision_id ORDER BY o.available_at DESC NULLS LAST, o.revision DESC, o.event_id DESC) AS r FROM d LEFT JOIN obs o ON o.entity = d.entity AND o.available_at <= d.deadline) x WHERE r = 1",
    "pit_filter": f"WITH {OBSERVATIONS} SELECT e.event_id AS decision_id, count(o.event_id)::BIGINT AS visible FROM events e LEFT JOIN obs o ON o.entity = e.user_id AND o.available_at <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id",
    "revision_as_of": f"WITH {OBSERVATIONS} SELECT event_id, revision, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY available_at DESC, revision DESC) AS r FROM obs WHERE available_at <= TIMESTAMP '2024-01-15') x WHERE r = 1",
    "embargo_filter": f"WITH {OBSERVATIONS} SELECT entity, count(*)::BIGINT AS n, max(available_at) AS latest FROM obs WHERE available_at + INTERVAL 48 HOUR <= TIMESTAMP '2024-01-20' GROUP BY entity",
    "rolling_origin_folds": _FOLD_SQL.format(rolling=1) + _FOLD_COUNT,
    "expanding_folds": _FOLD_SQL.format(rolling=0) + _FOLD_COUNT,
    "fold_standardise": _FOLD_SQL.format(rolling=0) + ", m AS (SELECT fold, avg(value) AS mean, stddev_samp(value) AS sd FROM r WHERE part = 'train' GROUP BY fold) SELECT fold, event_id, round((value - mean) / sd, 6) AS z FROM r JOIN m USING (fold) WHERE part = 'test'",
    "snapshot_diff": "WITH a AS (SELECT event_id, event_type, user_id FROM events WHERE event_id % 17 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'edited' ELSE event_type END AS event_type, user_id FROM events WHERE event_id % 11 <> 0) SELECT event_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (event_id) WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.event_type <> b.event_type",
    "beta_rate_forecast": _F + "event_id, round(p, 9) AS p FROM f",
    "brier_score": _F + "round(avg((p - y) * (p - y)), 6) AS brier FROM f",
    "log_loss": _F + "round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM f",
    "mae_rmse": _F + "round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM f",
    "calibration_slope": _F + "round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept FROM f",
    "reliability_bins": _F + "least(floor(p * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM f GROUP BY 1",
    "baseline_no_change": "SELECT round(avg(abs(value - last)), 6) AS mae, count(*)::BIGINT AS n FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) x WHERE last IS NOT NULL",
    "baseline_rolling_avg": "SELECT round(sqrt(avg((value - g) * (value - g))), 6) AS rmse, count(*)::BIGINT AS n FROM (SELECT value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g FROM events) x WHERE g IS NOT NULL",
    "crps_ensemble": "WITH e AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS d FROM events) SELECT event_id, round(list_avg(list_transform(d, lambda x: abs(x - value))) - list_sum(list_transform(d, lambda x: list_sum(list_transform(d, lambda z: abs(x - z))))) / 128, 9) AS crps FROM e WHERE len(d) = 8",
    "interval_coverage": "SELECT round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*)::BIGINT AS n FROM (SELECT value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) x WHERE n = 20",
    "block_bootstrap_ci": f"WITH {FORECASTS}, b AS (SELECT (row_number() OVER (ORDER BY d) - 1)::INT AS block, total, n FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS d, sum((p - y) * (p - y)) AS total, count(*) AS n FROM f GROUP BY 1) x), k AS (SELECT draw::INT AS draw, floor({_U.format("'7:' || draw || ':' || slot")} * (SELECT count(*) FROM b))::INT AS block FROM range(200) a(draw), range((SELECT count(*) FROM b)) s(slot)) SELECT draw, round(sum(total) / sum(n), 6) AS mean FROM k JOIN b USING (block) GROUP BY draw",
    "holm_adjust": "WITH t AS (SELECT event_type AS test, count(*) FILTER (value > 60) / count(*)::DOUBLE / 10 AS p FROM events GROUP BY 1), s AS (SELECT test, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1)) AS step FROM t) SELECT test, round(max(step) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9)::DOUBLE AS p_holm FROM s",
    "mc_simulation": f"WITH u AS (SELECT n_nationkey, {_U.format("'1:' || n_nationkey || ':' || draw")} AS own, {_U.format("'2:' || draw")} AS shared FROM nation, range(500) t(draw)) SELECT n_nationkey, round(avg(own), 9) AS mean, round(avg(CASE WHEN own + shared > 1 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS joint FROM u GROUP BY n_nationkey",
    "drift_psi": "WITH b AS (SELECT least(floor(value / 10), 9) AS bin, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1), s AS (SELECT (a + 0.5::DOUBLE) / (sum(a) OVER () + 5) AS x, (b + 0.5::DOUBLE) / (sum(b) OVER () + 5) AS y FROM b) SELECT round(sum((y - x) * ln(y / x)), 6) AS psi FROM s",
    "sessionize_gap": "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS begin, max(ts) AS \"end\" FROM t GROUP BY user_id, session",
    "json_extract": "SELECT props ->> '$.k' AS k, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "title_policy": r"SELECT title, regexp_full_match(title, '(?:feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(?:\([a-z0-9][a-z0-9._/-]*\))?!?: [a-z0-9][^\n]{2,72}') AND length(title) <= 100 AS valid FROM (VALUES " + ", ".join("('" + t.replace("\n", "' || chr(10) || '") + "')" for t in TITLES) + ") t(title)",
}
