"""Hard negatives against the DuckDB statement and a plain search."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import hard_negatives
from tidewater.llm.q13_hard_negatives import ORACLE, op13_hard_negatives

SMALL = "/root/testdata/sf0.001"
MOST = 2**63 - 1
SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def test_equal_to_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(ORACLE["op13_hard_negatives"])
    names = [d[0] for d in want.description]
    got = op13_hard_negatives(spark, SMALL).select(names).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())


def plain(rows, positives=5, negatives=5, window=(80, 100)):
    held = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(v), label) for i, v, label in held if i % 10 == 0}
    out = []
    for i, v, label in anchors:
        score = [(-max(-MOST, min(MOST, sum(a * b for a, b in zip(v, w)))), j, other) for j, w, other in held]
        for p, j, _ in sorted(s for s in score if s[2] == label and s[1] != i)[:positives]:
            fit = sorted(s for s in score if s[2] != label and window[0] * -p <= 100 * -s[0] <= window[1] * -p)
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_ties_copies_and_odd_rows(spark, seed, monkeypatch):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(n)]
    rows = [(i, draw(4), rng.randrange(3), "own") for i in range(120)]
    rows += [(200 + i, [0.25, 0.3, 1.0, 0.0], 1, "copy") for i in range(60)]
    rows += [(20, rows[20][1], rows[20][2], "again"), (20, draw(4), 1, "other"), (31, draw(4), None, "x"), (40, None, 1, "x"), (50, [1.0, None, 0.0, 0.0], 1, "x"), (60, [float("nan")] * 4, 1, "x"), (70, [float("inf"), 0.0], 2, "x"), (None, draw(4), 1, "x")]
    rows += [(80, [], 0, "short"), (81, [1.0], 0, "short"), (90, draw(9), 2, "long"), (91, draw(7), 1, "long")]
    rng.shuffle(rows)
    want = plain(rows)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 100)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 600)  # several blocks of anchors
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, window=(50, 90)) == plain(rows, 2, 3, (50, 90))


def test_scores_beyond_float64_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([2**20 + 1, 2**19 + 3, 5, -7])) for _ in range(3)], i % 2, "own") for i in range(60)]
    assert max(abs(r[4]) for r in plain(rows)) > 2**53
    assert mined(spark, rows) == plain(rows)
    huge = [(i, [3e38, -3e38 if i % 4 == 1 else 1e38], i % 2, "own") for i in range(12)]
    assert plain(huge) and mined(spark, huge) == plain(huge)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, "no anchor")]) == []
    assert mined(spark, [(10, [1.0], 1, "no positive"), (11, [1.0], 2, "x")]) == []
