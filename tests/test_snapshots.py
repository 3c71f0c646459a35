"""Digests of snapshots, audit links, peer-group frames and variants against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import merkle, ordering
from tidewater.sources import variants


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b double").repartition(4)


def changes(old, new):
    a, b = {r[0]: r for r in old}, {r[0]: r for r in new}
    return {k: "added" if k not in a else "removed" if k not in b else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


@pytest.mark.parametrize("case", ["one", "many", "none", "negative", "longer", "emptied", "filled", "ends"])
def test_differences_equal_a_whole_join(spark, case, monkeypatch):
    rng = random.Random(2)
    old = [(k, f"v{k % 7}", None if k % 5 == 0 else k / 2) for k in (range(-700, 900, 2) if case in ("negative", "ends") else range(0, 1600, 2))]
    new = list(old)
    if case == "one":
        new[321] = (new[321][0], None, 1.0)
    elif case == "negative":
        new = [(k, a, b if k not in (-700, -2, 0, 898) else -1.0) for k, a, b in new]
    elif case == "ends":
        new = [(-100000, "x", 0.0), *new[1:-1], (10**6, "y", None)]
    elif case == "longer":
        new += [(5000 + k, "n", 0.0) for k in range(300)]
    elif case == "emptied":
        new = []
    elif case == "filled":
        old, new = [], old
    elif case == "many":
        new = [r if rng.random() < 0.6 else (r[0], "edited", r[2]) for r in new if rng.random() < 0.9]
        monkeypatch.setattr(merkle, "MOST_BOUNDS", 3)
    got = merkle.diff(frame(spark, old), frame(spark, new), "k", ["a", "b"], 16)
    rows = got.collect()
    assert {r.k: r.change for r in rows} == changes(old, new) and len(rows) == len(changes(old, new))


def test_only_differing_ranges_are_read(spark, tmp_path):
    old = [(k, f"v{k % 7}", 0.5) for k in range(4000)]
    new = [(k, a, b if k != 1234 else 9.0) for k, a, b in old]
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    frame(spark, old).orderBy("k").write.parquet(a)
    frame(spark, new).orderBy("k").write.parquet(b)
    before, after = spark.read.parquet(a), spark.read.parquet(b)
    x, y = merkle.tree(before, "k", ["a", "b"]), merkle.tree(after, "k", ["a", "b"])
    assert x.root != y.root and x.rows == y.rows == 4000
    assert [r.idx for r in merkle.differing(x, y).collect()] == [1234 // merkle.WIDTH]
    got = merkle.diff(before, after, "k", ["a", "b"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    low = 1234 // merkle.WIDTH * merkle.WIDTH
    assert plan.count(f"GreaterThanOrEqual(k,{low})") >= 2 and plan.count(f"LessThan(k,{low + merkle.WIDTH})") >= 2
    assert [tuple(r) for r in got.collect()] == [(1234, "changed")]
    with pytest.raises(ValueError):
        merkle.differing(x, merkle.tree(after, "k", ["a"], width=8))


def test_roots_do_not_depend_on_order_but_on_repeated_rows_and_nulls(spark):
    rows = [(k, "v", float(k)) for k in range(500)]
    root = lambda r: merkle.tree(frame(spark, r), "k", ["a", "b"], 16).root
    whole = root(rows)
    assert whole == root(rows[::-1]) and whole != root(rows + rows[:1]) and whole != root([*rows[1:], (0, None, 0.0)])
    assert root([(0, None, None)]) != root([(0, "null", None)])
    assert root(rows + [(None, "x", 1.0)]) == whole and root([]) is None


def test_audit_links(spark):
    rows = spark.createDataFrame([(k, f"entry {k}") for k in range(1, 41)], "seq long, text string")
    held = merkle.linked(rows, "seq", ["text"]).cache()
    faults = lambda df, last=40: sorted(map(tuple, merkle.broken(df, "seq", ["text"], 1, last).collect()))
    assert faults(held) == []
    assert faults(held.filter("seq <> 17")) == [(18, "deleted")]
    assert faults(held.filter("seq <= 30")) == [(41, "deleted")] and faults(held.filter("seq > 1")) == [(2, "deleted")]
    changed = held.withColumn("text", F.when(F.col("seq") == 9, "forged").otherwise(F.col("text")))
    assert faults(changed) == [(9, "tampered")]
    redone = changed.withColumn("digest", merkle.row_digest(["seq", "text"]))
    assert faults(redone) == [(9, "relinked"), (10, "relinked")]
    assert faults(held.limit(0)) == [(41, "deleted")]


def test_group_frames(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 1, 4, 9]), rng.randrange(5)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, g string, x int, v long")
    for before, after in ((0, 0), (1, 0), (1, 1), (2, -1)):
        got = {r.i: (r.n, r.s) for r in ordering.group_frames(df, ["g"], [F.col("x").asc_nulls_first()], before, after, {"n": F.count("*"), "s": F.sum("v")}).collect()}
        for i, g, x, _ in rows:
            groups = sorted({y for _, h, y, _ in rows if h == g}, key=lambda y: (y is not None, y or 0))
            at = groups.index(x)
            inside = [v for _, h, y, v in rows if h == g and at - before <= groups.index(y) <= at + after]
            assert got[i] == (len(inside), sum(inside) if inside else None)


def test_shredded_columns_are_pushed_down_and_misfits_kept(spark, tmp_path):
    texts = ['{"k": 5, "o": {"s": "x", "t": "2024-01-02"}}', '{"k": "7"}', '{"k": "no"}', '{"k": null}', "{}", "{", "", None, "[1]", '{"k": 1, "k": 2}', '{"k": 3.9}', '{"k": 99999999999999999999}', "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, props string")
    got = variants.shredded(df, "props", {"k": ("$.k", "bigint"), "s": ("$.o.s", "string"), "t": ("$.o.t", "date")})
    rows = {r.i: r for r in got.collect()}
    assert [rows[i].state for i in range(len(texts))] == ["ok", "ok", "misfit", "ok", "ok", "malformed", "malformed", "none", "ok", "malformed", "ok", "misfit", "ok"]
    assert [rows[i].k for i in range(len(texts))] == [5, 7, None, None, None, None, None, None, None, None, 3, None, None]
    assert rows[0].s == "x" and str(rows[0].t) == "2024-01-02" and rows[5].props == "{"
    got.write.parquet(f"{tmp_path}/shredded")
    plan = spark.read.parquet(f"{tmp_path}/shredded").filter("k > 4").select("i")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,4)" in plan
    with pytest.raises(ValueError):
        variants.shredded(df, "props", {"I": ("$.k", "bigint")})
