"""Exact selection of a few items per group under a budget and a cap per kind.

``items`` has ``grp``, ``item``, ``kind``, and whole numbers ``price`` and ``value``.
Of each group ``size`` items are chosen, at most ``cap`` of one kind and of at most
``budget`` in all, with the greatest sum of values; of equal ones the cheapest,
then the one with the smallest items.

An item can't be needed if ``size`` others of its kind are as good and as cheap
(ties by item): one of them is free to take its place.  So Spark keeps, of each
group, kind and price, the best ``size`` items, which bounds a group by its
number of prices, not of its items; what is left is solved by branch and
bound, a group in a task.  A search that takes more than ``limit`` steps ends with the status
``limit``, an impossible one with ``infeasible``: neither selects anything.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "grp string, status string, items array<long>, value long, price long, steps long"
LIMIT = 5_000_000
SOLVER = "branch-and-bound 1"


def undominated(rows: list[tuple[int, str, int, int]], size: int) -> list[tuple[int, str, int, int]]:
    """(item, kind, price, value) rows by falling value without those that ``size`` others of their kind make needless."""
    out: list = []
    cheaper: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (-r[3], r[2], r[0])):
        before = cheaper.setdefault(row[1], [])  # prices of better items, the `size` smallest
        if sum(p <= row[2] for p in before) < size:
            out.append(row)
            before.append(row[2])
            before.sort()
            del before[size:]
    return out


def solve(rows: list[tuple[int, str, int, int]], size: int, cap: int, budget: int, limit: int = LIMIT) -> tuple[str, list[int] | None, int, int, int]:
    """(status, items, value, price, steps) of one group."""
    rows = undominated(rows, size)
    n, best, steps = len(rows), None, 0
    cheapest = [0] * (n + 1)  # least price from a place on
    for i in range(n - 1, -1, -1):
        cheapest[i] = min(rows[i][2], cheapest[i + 1]) if i < n - 1 else rows[i][2]
    stack: list[tuple[int, tuple[int, ...], int, int]] = [(0, (), 0, 0)]
    while stack:
        at, chosen, value, price = stack.pop()
        steps += 1
        if steps > limit:
            return "limit", None, 0, 0, steps
        if len(chosen) == size:
            key = (-value, price, tuple(sorted(rows[i][0] for i in chosen)))
            if best is None or key < best[0]:
                best = (key, chosen, value, price)
            continue
        left = size - len(chosen)
        if at + left > n or price + left * cheapest[at] > budget:
            continue
        if best is not None and value + sum(rows[i][3] for i in range(at, at + left)) < best[2]:
            continue  # values fall, so the next ones are the most that can come
        stack.append((at + 1, chosen, value, price))
        item = rows[at]
        if price + item[2] <= budget and Counter(rows[i][1] for i in chosen)[item[1]] < cap:
            stack.append((at + 1, (*chosen, at), value + item[3], price + item[2]))
    if best is None:
        return "infeasible", None, 0, 0, steps
    return "optimal", sorted(rows[i][0] for i in best[1]), best[2], best[3], steps


def select(items: DataFrame, rules: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``RESULT`` for each group of ``items``; ``rules`` has ``grp``, ``size``, ``cap`` and ``budget``, the same ``size`` for all groups."""
    largest = rules.agg(F.max("size")).first()[0] or 1
    order = Window.partitionBy("grp", "kind", "price").orderBy(F.desc("value"), "item")
    pool = items.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= largest).drop("_r")

    def run(key, frame):
        import pandas as pd

        first = frame.iloc[0]
        rows = list(zip(frame["item"].tolist(), frame["kind"].tolist(), frame["price"].tolist(), frame["value"].tolist(), strict=True))
        status, chosen, value, price, steps = solve(rows, int(first["size"]), int(first["cap"]), int(first["budget"]), limit)
        none = chosen is None
        return pd.DataFrame([(key[0], status, chosen, None if none else value, None if none else price, steps)], columns=["grp", "status", "items", "value", "price", "steps"]).astype({"value": "Int64", "price": "Int64"})

    return pool.join(rules, "grp").groupBy("grp").applyInPandas(run, RESULT)
