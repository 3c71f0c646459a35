"""Selection against all subsets, ranks and sums against plain ones, lineage with cycles, formats, and physical plans."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import decision, lineage, ordering, selection
from tidewater.sources import files


def brute(rows, size, cap, budget):
    best = None
    for some in itertools.combinations(sorted(rows), size):
        kinds = [r[1] for r in some]
        price, value = sum(r[2] for r in some), sum(r[3] for r in some)
        if price <= budget and all(kinds.count(k) <= cap for k in kinds):
            key = (-value, price, tuple(r[0] for r in some))
            best = key if best is None else min(best, key)
    return None if best is None else (list(best[2]), -best[0], best[1])


def items_of(rng, n, prices=6, values=5):
    return [(i, rng.choice("abc"), rng.randrange(1, prices), rng.randrange(values)) for i in rng.sample(range(1000), n)]


def test_solver_equals_all_subsets():
    rng = random.Random(4)
    for _ in range(400):
        rows, size, cap = items_of(rng, rng.randrange(12), rng.choice([3, 9]), rng.choice([2, 9])), rng.choice([1, 2, 3, 4]), rng.choice([1, 2, 4])
        budget = rng.randrange(1, 20)
        status, items, value, price, _ = selection.solve(rows, size, cap, budget)
        want = brute(rows, size, cap, budget)
        assert (status, items) == (("infeasible", None) if want is None else ("optimal", want[0]))
        assert want is None or (value, price) == want[1:]
        assert brute(selection.undominated(rows, size), size, cap, budget) == want


def test_selection_fails_safely_and_folds_large_groups(spark):
    rng = random.Random(5)
    groups = {"big": [(i, "ab"[i % 2], i % 4 + 1, i % 9) for i in range(3000)], "small": items_of(rng, 6), "poor": [(1, "a", 50, 1), (2, "b", 50, 1)], "two": [(1, "a", 1, 1)]}
    items = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "grp string, item long, kind string, price long, value long")
    rules = spark.createDataFrame([(g, 2, 1, 9) for g in groups], "grp string, size int, cap int, budget long")
    got = {r.grp: r for r in selection.select(items, rules).collect()}
    for g, rows in groups.items():
        want = brute([r for r in rows if g != "big" or r[0] < 200], 2, 1, 9)
        assert (got[g]["items"], got[g].value, got[g].price) == (want or (None, None, None)) and got[g].status == ("infeasible" if want is None else "optimal")
    few = selection.select(items, rules, limit=1).collect()
    assert {"limit"} < {r.status for r in few} <= {"limit", "infeasible"} and all(r["items"] is None for r in few)


def test_running_sums_and_ranks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1.5, 2.0, -3.25, 7.0, 100.0, None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    known = sorted(v for _, v in rows if v is not None)
    upto = {r.v: r.n for r in ordering.running(df, "v", {"n": "1"}).collect()}
    assert upto == {v: sum(x <= v for x in known) for v in set(known)}
    for down in (True, False):
        got = {r.id: r.place for r in ordering.ranked(df, "v", descending=down).collect()}
        assert got == {i: None if v is None else 1 + sum((x > v) if down else (x < v) for x in known) for i, v in rows}
    assert ordering.ranked(df.limit(0), "v").count() == 0


def test_lineage_with_cycles(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)} | {(20, 20)}
    got = {(r.snapshot, r.upstream): r.depth for r in lineage.closure(spark.createDataFrame(sorted(edges), "snapshot long, upstream long")).collect()}
    want, frontier, depth = {}, set(edges), 1
    while frontier:
        want |= {e: depth for e in frontier}
        frontier = {(a, d) for a, b in frontier for c, d in edges if b == c} - set(want)
        depth += 1
    assert got == want


def test_gaps(spark):
    got = decision.gaps(spark.createDataFrame([("a", 2), ("a", 5), ("b", 1)], "k string, n long"), "k", "n").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 3), ("a", 4)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_formats_keep_values(spark, tmp_path, kind):
    schema = StructType.fromDDL("i long, t string, d double, at timestamp_ntz, b boolean")
    rows = [(1, "plain", 0.1, None, True), (2, "", None, None, None), (3, None, -1e300, None, False), (4, 'a "quote", comma\nline é', 1 / 3, None, True), (5, "\\N x", 2.0, None, True)]
    df = spark.createDataFrame(rows, schema).withColumn("at", F.expr("timestamp_ntz'2024-02-29 23:59:59.123456'"))
    files.write(df, str(tmp_path / "t"), kind)
    back = files.read(spark, str(tmp_path / "t"), kind, schema)
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema == schema


def test_rows_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"i": 1, "t": "a"}\n{"i": "one", "t": "b"}\n{"i": 2\n')
    schema = StructType.fromDDL("i long, t string")
    good, bad = files.read_checked(spark, str(tmp_path / "x.json"), "json", schema)
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted(r[files.BAD] for r in bad.collect()) == ['{"i": "one", "t": "b"}', '{"i": 2']
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read(spark, str(tmp_path / "x.json"), "json", schema).collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("hint", "node"), [("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")])
def test_join_strategies_agree(spark, hint, node):
    a = spark.range(500).withColumn("k", F.col("id") % 37)
    b = spark.range(37).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    joined = a.join(b.hint(hint), "k")
    assert node in plan(joined)
    assert joined.agg(F.sum("v")).first()[0] == sum(i % 37 * 2 for i in range(500))


def test_filters_and_columns_reach_the_scan(spark):
    from tidewater.plans import catalog

    text = plan(catalog.QUERIES["filter_project"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(l_discount" in text and "l_shipdate" not in text.split("ReadSchema")[1]


def test_no_query_of_whole_tables_uses_one_task_for_ranks(spark):
    from tidewater.plans import catalog

    text = plan(catalog.QUERIES["league_rank"](spark, "/root/testdata/sf0.001"))
    assert "windowspecdefinition(total" not in text
