"""Calibration and forecasts by fitted models, over the forecasts of ``evidence``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, models
from .evidence import FORECASTS, forecasts

FEATURES = ["p", "seen", "hour", "weekday"]


def calibration_logistic(spark, sf_dir):
    """Intercept and slope of the log odds of outcomes over those of the running forecast."""
    a, b, converged, n = models.logistic_calibration(forecasts(spark, sf_dir))
    return spark.createDataFrame([(a, b, converged, n)], "intercept double, slope double, converged boolean, n long").select(F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), "converged", "n")


def featured(spark, sf_dir):
    """Forecast rows with what was known before the event: the running rate, events seen so far, hour and weekday."""
    from ..operators import temporal

    own = forecasts(spark, sf_dir).select("event_id", "user_id", "ts", "y", "p")
    own = temporal.running_before(own, "user_id", "ts", ["event_id"], {"seen": F.lit(1)})
    return own.withColumns({"hour": F.hour("ts"), "weekday": F.dayofweek("ts")})


def boosted_forecast(spark, sf_dir):
    """Log loss of the running rate, calibrated and by boosted trees, on the later half of the table's time; both are fitted on the earlier."""
    own = featured(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = own.agg(((F.min(at) + F.max(at)) / 2).alias("m")).first().m
    past, later = own.filter(at < middle), own.filter(at >= middle)
    fit = models.logistic_calibration(past)
    model = models.boost(past, FEATURES, "y", trees=8, depth=2)
    forecast = {"beta_rate": F.col("p"), "calibrated": models.calibrated(F.col("p"), fit), "boosted": model.predict()}
    each = later.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), c.alias("q")) for k, c in forecast.items()])).alias("f")).select("y", "f.*")
    return each.groupBy("model").agg(F.count("*").alias("n"), metrics.log_loss(F.col("q"), F.col("y")).alias("log_loss"), metrics.brier(F.col("q"), F.col("y")).alias("brier"))


QUERIES = {"calibration_logistic": calibration_logistic, "boosted_forecast": boosted_forecast}


def _newton(k: int) -> str:
    """Statement of the k-th Newton step from the one before."""
    mu = "(1 / (1 + exp(-(a + b * x))))"
    cut = lambda e: f"greatest(-{models.MOST_STEP}::DOUBLE, least({models.MOST_STEP}::DOUBLE, {e}))"
    return f"""s{k} AS (SELECT a + da AS a, b + db AS b, greatest(abs(da), abs(db)) AS last, n FROM (SELECT a, b, n, {cut('(h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)')} AS da, {cut('(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)')} AS db
      FROM (SELECT a, b, count(*) AS n, sum(y - {mu}) AS g0, sum((y - {mu}) * x) AS g1, sum({mu} * (1 - {mu})) AS h00, sum({mu} * (1 - {mu}) * x) AS h01, sum({mu} * (1 - {mu}) * x * x) AS h11 FROM g, s{k - 1} GROUP BY a, b) z) z)"""


ORACLE = {
    "calibration_logistic": f"WITH {FORECASTS}, g AS (SELECT ln(q / (1 - q)) AS x, y::DOUBLE AS y FROM (SELECT greatest(least(p::DOUBLE, 1 - {models.CLIP}), {models.CLIP}::DOUBLE) AS q, y FROM f) q), s0 AS (SELECT 0.0::DOUBLE AS a, 1.0::DOUBLE AS b), "
    + ", ".join(_newton(k) for k in range(1, models.STEPS + 1))
    + f" SELECT round(a, 6) AS intercept, round(b, 6) AS slope, last < {models.TOLERANCE} AS converged, n::BIGINT AS n FROM s{models.STEPS}"
}
