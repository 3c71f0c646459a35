"""Retrieval by inverted lists: recall of the exact way, blocks, scopes, times and odd rows."""

import numpy as np
import pytest

from tidewater.operators import retrieval
from tidewater.plans import discovery


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    named = lambda name: discovery.QUERIES[name](spark, f"/root/testdata/{sf}").withColumnRenamed("vec_id", "id").cache()
    found, exact = named("retrieval_inverted_lists"), named("retrieval_scoped")
    assert retrieval.recall(found, exact) >= 0.9
    assert found.count() <= exact.count() and exact.count() > 10


def rows(n=600, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 16))
    which = rng.integers(0, 12, n)
    v = (middles[which] + 0.3 * rng.normal(size=(n, 16))).round(3)
    return [(i, v[i].tolist(), int(rng.integers(0, 3)), int(rng.integers(0, 9))) for i in range(n)]


def plain(own, every, k=5):
    out = set()
    for q, v, scope, time in own:
        if q % every:
            continue
        scores = sorted((-round(float(np.dot(v, w)), 6), i) for i, w, s, t in own if i != q and s == scope and t <= time)
        out |= {(q, i, -score) for score, i in scores[:k]}
    return out


def frame(spark, own):
    df = spark.createDataFrame(own, "vec_id long, e array<double>, kind int, day int").selectExpr("*", "timestamp_micros(day) AS at", "1 AS query", "2 AS score")
    return retrieval.usable(df.repartition(4), "vec_id", "e", "kind", "at")


def test_clusters_blocks_and_exactness(spark, monkeypatch):
    own = rows()
    want = plain(own, 10)
    index = frame(spark, own)
    queries = index.filter("id % 10 = 0")
    centres = retrieval.quantiser(index, 12)
    assert centres.shape == (12, 16)
    got = retrieval.search(retrieval.assigned(index, centres), retrieval.assigned(queries, centres, 3), 5).cache()
    exact = spark.createDataFrame(sorted(want), "query long, id long, score double")
    assert retrieval.recall(got, exact) >= 0.9
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    whole = retrieval.search(retrieval.assigned(index, centres), retrieval.assigned(queries, centres, 12), 5).collect()
    assert {(r.query, r.id, r.score) for r in whole} == want and len(whole) == len(want)
    one = retrieval.search(retrieval.assigned(index, None), retrieval.assigned(queries, None), 5).collect()
    assert {(r.query, r.id, r.score) for r in one} == want


def test_odd_rows_and_empty_tables(spark):
    own = rows(60)
    odd = [(None, own[0][1], 1, 1), (1000, None, 1, 1), (1010, [1.0], 1, 1), (1020, [float("nan")] * 16, 1, 1), (1030, [None] * 16, 1, 1), (1040, own[0][1], None, 1), (1050, own[0][1], 1, None)]
    index = frame(spark, own + odd)
    queries = index.filter("id % 10 = 0")
    got = retrieval.search(retrieval.assigned(index, None), retrieval.assigned(queries, None), 5).collect()
    assert {(r.query, r.id, r.score) for r in got} == plain(own, 10)
    empty = index.limit(0)
    assert retrieval.quantiser(empty).shape[0] == 1
    assert retrieval.search(retrieval.assigned(empty, None), retrieval.assigned(empty, None), 5).count() == 0
    ties = frame(spark, [(i, [1.0, 0.0], 1, 1) for i in range(20)])
    got = retrieval.search(retrieval.assigned(ties, None), retrieval.assigned(ties.filter("id = 0"), None), 5).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]
