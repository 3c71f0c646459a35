"""Rules, deletions, lineage and Holm over rows that no query made."""

import datetime
import random

import pytest

from tidewater.operators import decision, deletion, lineage, metrics, rules

RULES = [
    ("owner", "owner", "required", None), ("state", "state", "one_of", "new, open"), ("score", "score", "at_least", "0.5"), ("score", "score", "at_most", "9"),
    ("code", "code", "matches", "^[A-Z]{2}[0-9]+$"), ("until", "until", "after", "2024-06-01"), ("order", "start", "before", "until"), ("exact", "kind", "equals", "a"),
]
SCHEMA = "id long, owner string, state string, score string, code string, start timestamp_ntz, until timestamp_ntz, kind string"


def test_each_test_and_nulls(spark):
    day = lambda m, d: datetime.datetime(2024, m, d)
    rows = [
        (1, "me", "new", "1", "AB1", day(1, 1), day(7, 1), "a"),
        (2, None, "old", "0.4", "ab1", day(8, 1), day(5, 1), "b"),
        (3, "  ", None, None, None, None, None, None),
        (4, "me", "open", "ten", "XY22x", day(7, 1), day(7, 1), "a"),
        (5, "me", "open", "10", "ZZ0", None, day(6, 1), "A"),
        (6, "me", "open", "9", "ZZ0", day(6, 2), None, "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.broken for r in rules.broken(df, RULES).collect()}
    assert got == {1: [], 2: ["owner", "state", "score", "code", "until", "order", "exact"], 3: ["owner"], 4: ["score", "code", "order"], 5: ["score", "exact"], 6: []}
    table = spark.createDataFrame(RULES, rules.SCHEMA)
    first = {r.id: r.problem for r in rules.first_broken(df, table).collect()}
    assert first == {k: v[0] if v else None for k, v in got.items()}
    assert rules.broken(df.limit(0), RULES).count() == 0
    assert {tuple(r.broken) for r in rules.broken(df, []).collect()} == {()}


@pytest.mark.parametrize("bad", [[("r", "no field", "required", None)], [("r", "owner", "no test", "x")], [("r", "owner", "equals", str(k)) for k in range(1001)]])
def test_bad_rules_are_errors(spark, bad):
    with pytest.raises(ValueError):
        rules.broken(spark.createDataFrame([("x",)], "owner string"), bad)


def test_deletion_sees_what_a_zone_holds_now(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "who long")
    before = keys(1, 1, 2, 3, None, 4)
    zones = {"clean": (before, keys(3, None, 4)), "forgot": (before, keys(1, 3, None, 4)), "too much": (before, keys(3)), "empty": (keys(), keys())}
    got = {r.zone: tuple(r)[1:] for r in deletion.effect(zones, keys(1, 2, 2, None), "who").collect()}
    assert got == {"clean": (6, 3, 0, 0), "forgot": (6, 4, 1, 0), "too much": (6, 1, 0, 2), "empty": (0, 0, 0, 0)}


def test_lineage_with_cycles_and_short_cuts(spark):
    rng = random.Random(6)
    edges = [(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(45))] + [(3, 3), (None, 2), (5, None)]
    want, step = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            step.setdefault(a, set()).add(b)
    for a in step:
        front, depth, seen = set(step[a]), 1, {}
        while front:
            seen.update({b: depth for b in front})
            front, depth = {c for b in front for c in step.get(b, ())} - seen.keys(), depth + 1
        want.update({(a, b): d for b, d in seen.items()})
    rows = lineage.closure(spark.createDataFrame(edges, "snapshot long, upstream long")).collect()
    assert {(r.snapshot, r.upstream): r.depth for r in rows} == want and len(rows) == len(want)


def test_holm_with_ties_and_nulls(spark):
    rng = random.Random(1)
    tests = [(f"t{i}", rng.choice([0.001, 0.01, 0.012, 0.04, 0.2, 0.9])) for i in range(40)] + [("none", None)]
    got = {r.test: r.p_holm for r in metrics.holm(spark.createDataFrame(tests, "test string, p double")).collect()}
    known, largest, want = sorted((p, t) for t, p in tests if p is not None), 0.0, {"none": None}
    for k, (p, t) in enumerate(known):
        largest = max(largest, min(1.0, p * (len(known) - k)))
        want[t] = largest
    assert got.keys() == want.keys() and all(got[t] is want[t] or abs(got[t] - want[t]) < 1e-12 for t in want)
    assert metrics.holm(spark.createDataFrame([], "test string, p double")).count() == 0


def test_broken_rules_of_units(spark):
    facts = spark.createDataFrame([("a", "brand", "x", 2), ("a", "brand", "y", 1), ("b", "brand", "x", 9)], "squad string, kind string, grp string, x long")
    table = [("v1", "brand", "x", 0, 3), ("v1", "brand", "y", 1, 5)]
    schema = "rule_version string, kind string, grp string, lo long, hi long"
    got = {(r.squad, r.grp, r.actual) for r in decision.broken_rules(facts, spark.createDataFrame(table, schema), "squad").collect()}
    assert got == {("b", "x", 9), ("b", "y", 0)}
    with pytest.raises(ValueError):
        decision.broken_rules(facts, spark.createDataFrame([("v1", "k", str(i), 0, 1) for i in range(1001)], schema), "squad")
