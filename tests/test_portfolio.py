"""Selection under risk and plans over periods against brute force."""

import itertools
import random

import numpy as np
import pytest

from tidewater.operators import portfolio


def brute(items, draws, size, cap, budget, percent, weight):
    best = None
    for chosen in itertools.combinations(range(len(items)), size):
        price, kinds = sum(items[i][2] for i in chosen), [items[i][1] for i in chosen]
        if price > budget or max(map(kinds.count, kinds)) > cap:
            continue
        totals = np.sort(draws[list(chosen)].sum(axis=0))
        k = max(1, -(-len(totals) * percent // 100))
        value = int(weight * k * totals.sum() + (100 - weight) * len(totals) * totals[:k].sum())
        key = (-value, price, tuple(sorted(items[i][0] for i in chosen)))
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(40))
def test_solver_equals_brute_force(seed):
    rng = random.Random(seed)
    n, scenarios, size = rng.randrange(1, 13), rng.randrange(1, 9), rng.randrange(1, 5)
    items = [(rng.randrange(1000) * 20 + i, rng.choice("abc"), rng.randrange(1, 12)) for i in range(n)]
    draws = np.array([[rng.choice([-5, 0, 0, 3, 9, 20]) for _ in range(scenarios)] for _ in range(n)], dtype=np.int64)
    args = size, rng.randrange(1, 4), rng.randrange(5, 40), rng.choice([1, 20, 50, 100]), rng.choice([0, 40, 100])
    status, chosen, value, _ = portfolio.solve(items, draws, *args)
    want = brute(items, draws, *args)
    if want is None:
        assert status == "infeasible" and chosen is None
    else:
        assert status == "optimal" and (-value, sum(items[i][2] for i in chosen), tuple(sorted(items[i][0] for i in chosen))) == want


def test_the_bound_prunes_and_the_limit_ends():
    rng = np.random.default_rng(3)
    items = [(i, "ab"[i % 2], 1) for i in range(40)]
    draws = rng.integers(0, 100, (40, 10))
    status, _, value, steps = portfolio.solve(items, draws, 3, 3, 10, 30, 40)
    assert status == "optimal" and steps < 9880  # the triples alone
    assert portfolio.solve(items, draws, 3, 3, 10, 30, 40, limit=10)[:2] == ("limit", None)


def test_many_items_and_copies_are_a_few_steps():
    """Copies of items and near ties were walked one by one."""
    rng = np.random.default_rng(5)
    draws = np.repeat(rng.integers(0, 400, (400, 7)), 60, axis=0)
    kinds = np.repeat(rng.integers(0, 6, 400), 60)
    prices = np.repeat(rng.integers(9000, 10500, 400), 60)
    items = [(int(i), f"k{t}", int(p)) for i, (t, p) in enumerate(zip(kinds, prices, strict=True))]
    status, chosen, value, steps = portfolio.solve(items, draws, 3, 2, 28000, 30, 40, limit=50_000)
    one = [(i // 60, t, p) for i, t, p in items[::60]]
    top = sorted(range(400), key=lambda i: -int(draws[i * 60].sum()))
    assert status == "optimal" and steps < 50_000
    # against all triples of the 120 best and what they cost, each three times
    few = [i * 60 + k for i in top[:40] for k in range(3)]
    own = [items[i] for i in few]
    assert -brute(own, draws[few], 3, 2, 28000, 30, 40)[0] <= value
    assert value == portfolio.objective(draws[chosen].sum(axis=0), 3, 40) and len({*chosen}) == 3 and len(one) == 400


@pytest.mark.parametrize("seed", range(30))
def test_ties_of_copies_equal_brute_force(seed):
    rng = random.Random(seed)
    kinds = [(rng.choice("ab"), [rng.choice([0, 1, 4]) for _ in range(12)]) for _ in range(4)]
    rows = [(i, *rng.choice(kinds), rng.randrange(1, 4)) for i in rng.sample(range(99), 13)]
    items, draws = [(i, t, p) for i, t, _, p in rows], np.array([d for _, _, d, _ in rows], dtype=np.int64)
    args = rng.randrange(1, 5), rng.randrange(1, 4), rng.randrange(4, 12), rng.choice([20, 50]), rng.choice([0, 40, 100])
    status, chosen, value, _ = portfolio.solve(items, draws, *args)
    want = brute(items, draws, *args)
    assert (status == "infeasible") == (want is None)
    if want is not None:
        assert (-value, sum(items[i][2] for i in chosen), tuple(sorted(items[i][0] for i in chosen))) == want


def test_risk_changes_the_choice(spark):
    rows = [("g", 1, "a", 1, [100, 0]), ("g", 2, "b", 1, [40, 40]), ("g", 3, "c", 1, None), ("g", 4, "c", 1, [1, None]), ("h", 5, "a", 9, [1, 1])]
    items = spark.createDataFrame(rows, "grp string, item long, kind string, price long, draws array<long>")
    rules = spark.createDataFrame([("g", 1, 1, 5), ("h", 1, 1, 5)], "grp string, size int, cap int, budget long")
    got = {w: {r.grp: (r.status, r["items"]) for r in portfolio.select_under_risk(items, rules, 50, w).collect()} for w in (100, 0)}
    assert got[100] == {"g": ("optimal", [1]), "h": ("infeasible", None)} and got[0]["g"] == ("optimal", [2])


def brute_plan(values, periods, cost):
    best = None
    for way in itertools.product(*[sorted(s for s in values.get(p, {})) for p in periods]):
        total = sum(values[p][s] for p, s in zip(periods, way)) - cost * sum(a != b for a, b in zip(way, way[1:]))
        best = max(best, total) if best is not None else total
    return best


@pytest.mark.parametrize("seed", range(3))
def test_plans_equal_brute_force_over_three_periods(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{g}", p, f"s{s}", rng.randrange(0, 12)) for g in range(12) for p in (1, 2, 3) for s in range(5) if rng.random() < 0.7 and not (g == 3 and p == 2)]
    rows += [("g9", 1, "s0", None), ("lonely", 2, "s1", 4), ("none", 1, "s1", None)]
    df = spark.createDataFrame(rows, "grp string, period int, state string, value long").repartition(4)
    got = {r.grp: r for r in portfolio.choose_over_periods(df, 5).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        values = {p: {s: v for h, q, s, v in rows if h == g and q == p and v is not None} for p in (1, 2, 3)}
        want = brute_plan(values, (1, 2, 3), 5)
        assert r.total == want and r.status == ("infeasible" if want is None else "optimal")
        if want is not None:
            assert sum(values[p][s] for p, s in zip((1, 2, 3), r.states)) - 5 * r.changes == want
            assert r.changes == sum(a != b for a, b in zip(r.states, r.states[1:]))
        else:
            assert r.states is None
    assert got["g3"].status == got["lonely"].status == got["none"].status == "infeasible"
    assert portfolio.choose_over_periods(df.limit(0), 5).count() == 0
    assert [r.status for r in portfolio.choose_over_periods(df.filter("grp = 'none'"), 5).collect()] == ["infeasible"]
