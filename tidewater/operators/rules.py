"""Rows against a table of rules: which fields break which rule.

``rules`` has ``rule``, ``field``, ``test`` and ``argument``, a row for each rule:

| test | holds if the field |
|-|-|
| required | has a value that isn't an empty text |
| equals, one_of | is the argument, or one of those that commas part |
| matches | has a match of the argument as a pattern |
| at_least, at_most | is a number not under, or over, the argument |
| before, after | is a time before, or not before, the argument (a time or another field's name) |

A null holds for every test but ``required``, so that a missing value is one fault; a value that
isn't a number or time where one is asked for breaks the rule.  A rule over a field that the rows don't have is an
error.  Rules are a policy, at most ``MOST`` of them, and become one expression, so rows
are read once and aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1000
SCHEMA = "rule string, field string, test string, argument string"


def _holds(rows: DataFrame, field: str, test: str, argument: str | None) -> Column:
    if field not in rows.columns:
        raise ValueError(f"a rule is over a field that isn't there: {field}")
    own = F.col(f"`{field}`")
    text = own.cast("string")
    if test == "required":
        return own.isNotNull() & (F.trim(text) != "")
    if test == "equals":
        held = text == argument
    elif test == "one_of":
        held = text.isin([a.strip() for a in argument.split(",")])
    elif test == "matches":
        held = text.rlike(argument)
    elif test in ("at_least", "at_most"):
        number = text.try_cast("double")
        held = F.coalesce(number >= float(argument) if test == "at_least" else number <= float(argument), F.lit(False))
    elif test in ("before", "after"):
        at = text.try_cast("timestamp")
        bound = F.col(f"`{argument}`").cast("timestamp") if argument in rows.columns else F.lit(argument).cast("timestamp")
        held = F.coalesce(at < bound if test == "before" else at >= bound, at.isNotNull() & bound.isNull())
    else:
        raise ValueError(f"no such test: {test}")
    return own.isNull() | held


def broken(rows: DataFrame, rules: DataFrame | list[tuple], name: str = "broken") -> DataFrame:
    """``rows`` and, last, the names of the rules that each breaks, in the order of the table: an empty array for none.

    ``name`` must not be a column of ``rows`` yet.  Rules of one name are one rule: all of its tests have to hold.
    """
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    table = rules if isinstance(rules, list) else [tuple(r) for r in rules.select("rule", "field", "test", "argument").limit(MOST + 1).collect()]
    if len(table) > MOST:
        raise ValueError(f"more than {MOST} rules")
    holds: dict[str, Column] = {}
    for rule, field, test, argument in table:
        one = _holds(rows, field, test, argument)
        holds[rule] = holds[rule] & one if rule in holds else one
    faults = [F.when(~h, F.lit(r)) for r, h in holds.items()]
    return rows.withColumn(name, F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>"))


def first_broken(rows: DataFrame, rules: DataFrame | list[tuple], name: str = "problem") -> DataFrame:
    """``rows`` and the first rule that each breaks, null where all hold."""
    return broken(rows, rules, "_broken").withColumn(name, F.get("_broken", F.lit(0))).drop("_broken")
