"""Decisions and their rules: regret, broken rules, gaps in a registry, the choice of a model, shared word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MOST_RULES = 1000


def regret(options: DataFrame, by: str) -> DataFrame:
    """``options`` has ``option``, ``expected`` and ``realised``; the one of greatest expectation is chosen (of equal ones the last by name).

    Regret is against the best realised value among the options known at the same time.
    """
    best = F.max(F.struct("expected", "option", "realised"))
    found = options.groupBy(by).agg(best.alias("c"), F.max("realised").alias("top"), F.count("*").alias("options"))
    return found.select(by, F.col("c.option").alias("chosen"), F.round(F.col("top") - F.col("c.realised"), 6).alias("regret"), "options")


def broken_rules(facts: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """``facts`` has ``by``, ``kind``, ``grp`` and an amount ``x``; ``rules`` has bounds ``lo`` and ``hi`` of the sum of each kind and group.

    The rules are a policy of at most ``MOST_RULES``, which is checked, and join by name; only units (``by``) times rules are
    made, so that a group that a unit lacks is checked as zero.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    sums = facts.groupBy(by, "kind", "grp").agg(F.sum("x").alias("actual"))
    wanted = facts.select(by).distinct().join(F.broadcast(rules))
    actual = F.coalesce("actual", F.lit(0).cast("long"))
    return wanted.join(sums, [by, "kind", "grp"], "left").withColumn("actual", actual).filter("actual < lo or actual > hi").select(by, "rule_version", "kind", "grp", "actual", "lo", "hi")


def gaps(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers from 1 to the greatest of each ``by`` that have no row."""
    w = Window.partitionBy(by).orderBy(number)
    before = rows.select(by, F.col(number).alias("_n"), F.coalesce(F.lag(number).over(w), F.lit(0)).alias("_before")).filter("_n > _before + 1")
    return before.select(by, F.explode(F.sequence(F.col("_before") + 1, F.col("_n") - 1)).alias(number))


def simplest(models: DataFrame) -> DataFrame:
    """``models`` (a row for each: ``complexity``, ``mean`` error, ``se``) with ``chosen``: the simplest within one standard error of the best."""
    bound = models.agg(F.min(F.struct("mean", "se")).alias("best")).select((F.col("best.mean") + F.col("best.se")).alias("_bound"))
    within = models.crossJoin(F.broadcast(bound)).withColumn("_in", F.col("mean") <= F.col("_bound"))
    chosen = within.filter("_in").agg(F.min("complexity").alias("_chosen"))
    return within.crossJoin(F.broadcast(chosen)).withColumn("chosen", F.col("complexity") == F.col("_chosen")).drop("_bound", "_in", "_chosen")


def word_grams(frame: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(key, gram)``: the different runs of ``n`` words of each text, words being lower-cased runs without blanks."""
    words = frame.select(key, F.array_remove(F.split(F.lower(text), "[ \t\n\r]+"), "").alias("_w")).filter(F.size("_w") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))
    return words.select(key, F.explode(F.array_distinct(runs)).alias("gram"))
