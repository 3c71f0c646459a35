"""Selections under risk, and choices over several periods.

``select_under_risk`` takes draws of all items that share their scenarios: the objective is a
mix of the mean over scenarios and the mean of the worst share of them (CVaR).
``choose_over_periods`` chooses a state in each period, where a change costs.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .selection import LIMIT

RESULT = "grp string, status string, items array<long>, objective long, total long, tail long, price long, steps long"

#: Most sets of scenarios that a bound is taken over.
WORST_SETS = 40


def worst(scenarios: int, percent: int) -> int:
    """Number of scenarios in the worst ``percent`` of them, one at least."""
    return max(1, -(-scenarios * percent // 100))


def objective(totals: np.ndarray, k: int, weight: int) -> int:
    """``weight`` percent of the mean of ``totals`` and the rest of the mean of the lowest ``k``, times 100, their number and ``k``: a whole number."""
    return int(weight * k * totals.sum() + (100 - weight) * len(totals) * np.sort(totals)[:k].sum())


def worst_sets(draws: np.ndarray, k: int, most: int = WORST_SETS) -> np.ndarray:
    """Sets of ``k`` scenarios, a row of 0 and 1 for each: all there are, or ``most`` in which good items are at their worst."""
    scenarios = draws.shape[1]
    if comb(scenarios, k) <= most:
        chosen = list(combinations(range(scenarios), k))
    else:
        best = draws[np.argsort(-draws.sum(axis=1), kind="stable")[: most - 1]]
        chosen = [np.argsort(row, kind="stable")[:k] for row in (draws.sum(axis=0), *best)]
    sets = np.zeros((len(chosen), scenarios), dtype=np.int64)
    for row, own in zip(sets, chosen, strict=True):
        row[list(own)] = 1
    return np.unique(sets, axis=0)


def undominated(items: list[tuple[int, str, int]], draws: np.ndarray, size: int) -> list[int]:
    """Places of the items without those that ``size`` others of their kind with the same draws make needless, being cheaper or of one price and smaller."""
    seen: Counter = Counter()
    out = []
    for i in sorted(range(len(items)), key=lambda i: (items[i][2], items[i][0])):
        own = items[i][1], draws[i].tobytes()
        seen[own] += 1
        if seen[own] <= size:
            out.append(i)
    return out


def solve(items: list[tuple[int, str, int]], draws: np.ndarray, size: int, cap: int, budget: int, percent: int, weight: int, limit: int = LIMIT) -> tuple[str, list[int] | None, int, int]:
    """(status, places, objective, steps) of one group: ``items`` are (item, kind, price), ``draws`` has a row for each.

    The bound: the lowest k of a whole selection's totals add up to no more than any k of them, so each set of k
    scenarios (``worst_sets``) makes the objective a sum over items, of which the best that are left are added; the least
    sum over the sets holds.  A step bounds all items that may come next at once, and goes on with the
    best of them; the last item of a selection is chosen among all at once.
    """
    if size < 1:
        return "optimal", [], 0, 0
    if cap < 1 or size > len(items):
        return "infeasible", None, 0, 0
    k, scenarios = worst(draws.shape[1], percent), draws.shape[1]
    places = np.array(undominated(items, draws, size))
    own = np.ascontiguousarray(draws[places])
    number = np.array([items[i][0] for i in places])
    price = np.array([items[i][2] for i in places])
    kind = np.unique([repr(items[i][1]) for i in places], return_inverse=True)[1]
    gains = weight * k * own.sum(axis=1)[:, None] + (100 - weight) * scenarios * (own @ worst_sets(own, k).T)
    best: tuple | None = None
    steps = 0

    def ends(chosen: tuple[int, ...], after: np.ndarray, totals: np.ndarray) -> None:
        """The best selection that one of ``after`` completes."""
        nonlocal best
        whole = totals + own[after]
        low = np.partition(whole, k - 1, axis=1)[:, :k].sum(axis=1) if k < scenarios else whole.sum(axis=1)
        value = weight * k * whole.sum(axis=1) + (100 - weight) * scenarios * low
        if best is not None and value.max() < -best[0][0]:
            return
        top = after[value == value.max()]
        top = top[price[top] == price[top].min()]
        one = int(top[number[top].argmin()])
        held = (*chosen, one)
        key = (-int(value.max()), int(price[list(held)].sum()), tuple(sorted(int(number[i]) for i in held)))
        if best is None or key < best[0]:
            best = (key, held)

    # (chosen, those that may follow)
    stack: list[tuple[tuple[int, ...], np.ndarray]] = [((), np.arange(len(places)))]
    while stack:
        chosen, after = stack.pop()
        steps += 1
        if steps > limit:
            return "limit", None, 0, steps
        left, spent, held = size - len(chosen), int(price[list(chosen)].sum()) if chosen else 0, Counter(int(kind[i]) for i in chosen)
        full = [t for t, n in held.items() if n >= cap]
        if full:
            after = after[~np.isin(kind[after], full)]
        if len(after) < left:
            continue
        cheap = np.partition(price[after], left - 2)[: left - 1].sum() if left > 1 else 0  # at least this for the others
        after = after[price[after] + spent + cheap <= budget]
        if len(after) < left:
            continue
        totals = own[list(chosen)].sum(axis=0) if chosen else np.zeros(scenarios, dtype=np.int64)
        if left == 1:
            ends(chosen, after, totals)
            continue
        now = gains[list(chosen)].sum(axis=0) if chosen else np.zeros(gains.shape[1], dtype=np.int64)
        others = np.partition(gains[after], len(after) - (left - 1), axis=0)[-(left - 1) :].sum(axis=0)
        bound = (gains[after] + (now + others)).min(axis=1)
        if best is not None:
            after, bound = after[bound >= -best[0][0]], bound[bound >= -best[0][0]]
        order = np.lexsort((number[after], -bound))
        after, bound = after[order], bound[order]
        if len(after) < left:
            continue
        if left == 2:
            for i in range(len(after) - 1):
                if best is not None and bound[i] < -best[0][0]:
                    break
                rest = after[i + 1 :] if best is None else after[i + 1 :][bound[i + 1 :] >= -best[0][0]]
                rest = rest[price[rest] + price[after[i]] + spent <= budget]
                if held[int(kind[after[i]])] + 1 >= cap:
                    rest = rest[kind[rest] != kind[after[i]]]
                steps += 1
                if steps > limit:
                    return "limit", None, 0, steps
                if len(rest):
                    ends((*chosen, int(after[i])), rest, totals + own[after[i]])
            continue
        # the first of ``after`` is chosen, or it is left out, when the rest are bounded anew as the best has risen
        stack.append((chosen, after[1:]))
        stack.append(((*chosen, int(after[0])), after[1:]))
    if best is None:
        return "infeasible", None, 0, steps
    return "optimal", [int(places[i]) for i in best[1]], -best[0][0], steps


def select_under_risk(items: DataFrame, rules: DataFrame, percent: int, weight: int, limit: int = LIMIT) -> DataFrame:
    """``RESULT`` for each group of ``items`` (grp, item, kind, price, draws); ``rules`` (grp, size, cap, budget).

    ``draws`` are whole numbers, one for each scenario, in one order for all items; an item
    with another number of draws than its group's first, or with a null, takes no part.
    ``total`` is the sum over scenarios, ``tail`` the sum of the worst ones.  Of equal objectives the cheapest is
    chosen, then the smallest items.  Of items of one kind with the same draws only the ``size`` cheapest can be chosen (the
    smallest ones of one price), so only those go to a group's task: its items are those that a choice is made of.
    """

    def run(key, frame):
        import pandas as pd

        first = frame.iloc[0]
        rows = [(int(i), k, int(p), d) for i, k, p, d in zip(frame["item"], frame["kind"], frame["price"], frame["draws"], strict=True) if len(d) == len(first["draws"])]
        draws = np.array([r[3] for r in rows], dtype=np.int64)
        status, chosen, value, steps = solve([r[:3] for r in rows], draws, int(first["size"]), int(first["cap"]), int(first["budget"]), percent, weight, limit)
        out = [key[0], status, None, None, None, None, None, steps]
        if chosen is not None:
            totals = draws[chosen].sum(axis=0)
            out[2:7] = sorted(rows[i][0] for i in chosen), value, int(totals.sum()), int(np.sort(totals)[: worst(len(totals), percent)].sum()), sum(rows[i][2] for i in chosen)
        return pd.DataFrame([out], columns=["grp", "status", "items", "objective", "total", "tail", "price", "steps"]).astype({c: "Int64" for c in ("objective", "total", "tail", "price")})

    whole = items.filter(F.forall("draws", lambda x: x.isNotNull()) & F.col("price").isNotNull())
    alike = Window.partitionBy("grp", "kind", "draws").orderBy("price", "item")
    joined = whole.select("grp", "item", "kind", "price", "draws").join(rules, "grp").withColumn("_place", F.row_number().over(alike))
    # one row stays where none can be chosen, so that the group is reported
    return joined.filter(F.col("_place") <= F.greatest("size", F.lit(1))).drop("_place").groupBy("grp").applyInPandas(run, RESULT)


def choose_over_periods(values: DataFrame, cost: float) -> DataFrame:
    """``(grp, status, states, changes, total)``: of each group the states, one in each period, with the greatest sum of values less ``cost`` for each change.

    ``values`` has ``grp``, ``period``, ``state`` and ``value``; a state that a group doesn't have in a period (or has with a null value) is not
    feasible there.  A group without a feasible state in one of the periods of ``values`` is ``infeasible`` and selects nothing.  Of equal ways
    a step stays rather than changes, and goes to or ends with the smaller state.

    A dynamic programme, a period at a time: a state's best way stays, or comes from the group's best one.  So a period
    costs one aggregate and two joins, however many states a group has; ways are followed back at the end.
    """
    known = durable(values.filter(F.col("value").isNotNull() & F.col("grp").isNotNull() & F.col("state").isNotNull()).groupBy("grp", "period", "state").agg(F.max("value").alias("value")))
    groups = durable(values.filter("grp IS NOT NULL").select("grp").distinct())
    periods = [r.period for r in known.select("period").distinct().orderBy("period").collect()]  # a plan's horizon
    steps: list[DataFrame] = []
    for period in periods:
        here = known.filter(F.col("period") == period).select("grp", "state", "value")
        if not steps:
            steps.append(durable(here.withColumn("score", F.col("value")).withColumn("came", F.lit(None).cast(known.schema["state"].dataType))))
            continue
        before = steps[-1]
        top = before.groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("least"), F.col("state"))).alias("top")).select("grp", (-F.col("top.least")).alias("top"), F.col("top.state").alias("top_state"))
        stays = before.select("grp", "state", F.col("score").alias("stay"))
        both = here.join(top, "grp").join(stays, ["grp", "state"], "left")
        change = F.col("top") - F.lit(cost)
        keep = F.col("stay").isNotNull() & (F.col("stay") >= change)
        steps.append(durable(both.select("grp", "state", "value", (F.col("value") + F.when(keep, F.col("stay")).otherwise(change)).alias("score"), F.when(keep, F.col("state")).otherwise(F.col("top_state")).alias("came"))))
    if not steps:
        states = known.schema["state"].dataType.simpleString()
        return groups.selectExpr("grp", "'infeasible' AS status", f"CAST(NULL AS array<{states}>) AS states", "CAST(NULL AS int) AS changes", f"CAST(NULL AS {known.schema['value'].dataType.simpleString()}) AS total")
    last = steps[-1].groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("least"), F.col("state"), F.col("came"))).alias("end"))
    way = durable(last.select("grp", (-F.col("end.least")).alias("total"), F.col("end.state").alias("state"), F.col("end.came").alias("came"), F.array("end.state").alias("states")))
    for step in reversed(steps[:-1]):
        way = durable(way.select("grp", "total", "states", F.col("came").alias("state")).join(step.select("grp", "state", "came"), ["grp", "state"]).select("grp", "total", "state", "came", F.concat(F.array("state"), F.col("states")).alias("states")))
    changes = F.size(F.filter(F.sequence(F.lit(1), F.lit(max(len(periods) - 1, 1))), lambda i: F.coalesce(F.get("states", i) != F.get("states", i - 1), F.lit(False))))
    found = way.select("grp", "states", changes.alias("changes"), "total")
    return groups.join(found, "grp", "left").select("grp", F.when(F.col("states").isNull(), "infeasible").otherwise("optimal").alias("status"), "states", "changes", "total")
