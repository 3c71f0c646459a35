"""Simulation with recorded seeds: every draw is a hash of (seed, what it is for, draw number), so any partition gives the same numbers.

Teams are nations, fixtures too, players are suppliers.  A factor that players
share leaves the player out of its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import uniform
from ..session import table

DRAWS = 100
SEED = 11


def draw(name: str, *parts: str) -> Column:
    return uniform(F.lit(SEED), F.lit(name), *[F.col(p) for p in parts])


def players(spark: SparkSession, sf_dir: str, draws: int = DRAWS) -> DataFrame:
    """Each player with each draw; nothing but keys is repeated."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("player"))
    return own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def mc_shared_factor(spark, sf_dir):
    """A team's clean sheet (4 points for each player, chance 0.4) is one draw for all its players; own points are 2 at a chance of 0.3."""
    points = F.when(draw("sheet", "team", "draw") < 0.4, 4.0).otherwise(0.0) + F.when(draw("own", "player", "draw") < 0.3, 2.0).otherwise(0.0)
    totals = players(spark, sf_dir).groupBy("team", "draw").agg(F.sum(points).alias("total"))
    return totals.groupBy("team").agg(F.round(F.avg("total"), 6).alias("mean"), F.round(F.stddev_samp("total"), 6).alias("sd"))


def mc_exclusive_event(spark, sf_dir):
    """One player of each team scores in each draw: a uniform number falls into one of the players' cumulative shares."""
    w = Window.partitionBy("team").orderBy("player")
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("player"), (F.col("s_suppkey") % 3 + 1).alias("weight"))
    upto, whole = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(Window.partitionBy("team"))
    shares = own.select("team", "player", ((upto - F.col("weight")) / whole).alias("lo"), (upto / whole).alias("hi"))
    draws = own.select("team").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("u", draw("scorer", "team", "draw"))
    hits = draws.join(shares, "team").filter("u >= lo and u < hi").groupBy("player").agg(F.count("*").alias("wins"))
    return own.select("player").join(hits, "player", "left").select("player", F.coalesce("wins", F.lit(0).cast("long")).alias("wins"))


def _state() -> Column:
    u = draw("state", "player", "draw")
    return F.when(u < 0.2, "absent").when(u < 0.5, "late").otherwise("start")


def mc_state_mixture(spark, sf_dir):
    """A state is drawn first; the value depends on it."""
    u = draw("value", "player", "draw")
    own = players(spark, sf_dir).withColumn("state", _state())
    value = F.when(F.col("state") == "absent", 0.0).when(F.col("state") == "late", 1 + u).otherwise(2 + 2 * u)
    return own.groupBy("player").agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.avg((F.col("state") == "start").cast("double")), 6).alias("p_start"))


def mc_postponement(spark, sf_dir):
    """A fixture is postponed at a chance of 0.1, for all its players at once."""
    off = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).filter(draw("off", "team", "draw") < 0.1).select("team", "draw", F.lit(True).alias("off"))
    own = players(spark, sf_dir).join(off, ["team", "draw"], "left")
    value = F.when(F.col("off"), 0.0).otherwise(draw("value", "player", "draw"))
    return own.groupBy("player").agg(F.round(F.avg(value), 6).alias("mean"), F.count_if(F.col("off").isNull()).alias("played"))


def mc_convergence(spark, sf_dir):
    """Mean and standard error of a team's shared draw after 10, 100 and 1,000 draws."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("draw")).withColumn("u", draw("sheet", "team", "draw"))
    steps = own.withColumn("n", F.explode(F.filter(F.array(F.lit(10), F.lit(100), F.lit(1000)), lambda n: n > F.col("draw"))))
    return steps.groupBy("team", "n").agg(F.round(F.avg("u"), 6).alias("mean"), F.round(F.stddev_samp("u") / F.sqrt(F.count("*")), 6).alias("se"))


SCENARIOS = [("base", 1.0, 0.0), ("rain", 0.9, 0.0), ("late news", 1.0, -0.25), ("both", 0.9, -0.25)]


def scenario_compare(spark, sf_dir):
    """Scenarios scale and shift what a team is expected to give; the inputs stay as they are and each result stands beside the base."""
    scenarios = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("scale"), F.lit(d).alias("shift")) for n, s, d in SCENARIOS]))
    base = players(spark, sf_dir).groupBy("team").agg(F.avg(draw("value", "player", "draw")).alias("base"))
    value = F.col("base") * F.col("s.scale") + F.col("s.shift")
    return base.withColumn("s", scenarios).select("team", "s.scenario", F.round(value, 6).alias("value"), F.round(value - F.col("base"), 6).alias("change"))


QUERIES = {f.__name__: f for f in (mc_shared_factor, mc_exclusive_event, mc_state_mixture, mc_postponement, mc_convergence, scenario_compare)}


def _u(name: str, *parts: str) -> str:
    return f"('0x' || substr(md5('{SEED}:{name}:' || {' || chr(58) || '.join(parts)}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


_P = f"p AS (SELECT s_nationkey AS team, s_suppkey AS player, draw::INT AS draw FROM supplier, range({DRAWS}) t(draw))"
ORACLE = {
    "mc_shared_factor": f"WITH {_P}, t AS (SELECT team, draw, sum(CASE WHEN {_u('sheet', 'team', 'draw')} < 0.4 THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN {_u('own', 'player', 'draw')} < 0.3 THEN 2.0::DOUBLE ELSE 0 END) AS total FROM p GROUP BY ALL) SELECT team, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd FROM t GROUP BY team",
    "mc_exclusive_event": f"WITH o AS (SELECT s_nationkey AS team, s_suppkey AS player, s_suppkey % 3 + 1 AS weight FROM supplier), s AS (SELECT team, player, (sum(weight) OVER w - weight) / (sum(weight) OVER (PARTITION BY team))::DOUBLE AS lo, (sum(weight) OVER w) / (sum(weight) OVER (PARTITION BY team))::DOUBLE AS hi FROM o WINDOW w AS (PARTITION BY team ORDER BY player)), d AS (SELECT team, {_u('scorer', 'team', 'draw')} AS u FROM (SELECT DISTINCT team FROM o) x, range({DRAWS}) t(draw)) SELECT player, count(u)::BIGINT AS wins FROM s LEFT JOIN d ON d.team = s.team AND u >= lo AND u < hi GROUP BY player",
    "mc_state_mixture": f"WITH {_P}, u AS (SELECT player, {_u('state', 'player', 'draw')} AS s, {_u('value', 'player', 'draw')} AS v FROM p) SELECT player, round(avg(CASE WHEN s < 0.2 THEN 0 WHEN s < 0.5 THEN 1 + v ELSE 2 + 2 * v END), 6) AS mean, round(avg(CASE WHEN s >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_start FROM u GROUP BY player",
    "mc_postponement": f"WITH {_P}, u AS (SELECT player, {_u('off', 'team', 'draw')} < 0.1 AS off, {_u('value', 'player', 'draw')} AS v FROM p) SELECT player, round(avg(CASE WHEN off THEN 0 ELSE v END), 6) AS mean, count(*) FILTER (NOT off)::BIGINT AS played FROM u GROUP BY player",
    "mc_convergence": f"WITH d AS (SELECT n_nationkey AS team, draw, {_u('sheet', 'n_nationkey', 'draw')} AS u FROM nation, range(1000) t(draw)) SELECT team, n::INT AS n, round(avg(u), 6) AS mean, round(stddev_samp(u) / sqrt(count(*)), 6) AS se FROM d JOIN (VALUES (10), (100), (1000)) k(n) ON n > draw GROUP BY team, n",
    "scenario_compare": f"WITH {_P}, b AS (SELECT team, avg({_u('value', 'player', 'draw')}) AS base FROM p GROUP BY team), s(scenario, scale, shift) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in SCENARIOS) + ") SELECT team, scenario, round(base * scale + shift, 6) AS value, round(base * scale + shift - base, 6) AS change FROM b, s",
}
