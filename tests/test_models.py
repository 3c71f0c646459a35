"""Calibration against a plain fit, boosting against a plain version, and both on held-out rows."""

import math
import random

import pytest

from tidewater.operators import models
from tidewater.plans import models as plans


def test_logistic_calibration_finds_the_planted_line(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(6000):
        p = rng.random()
        q = 1 / (1 + math.exp(-(0.4 + 0.6 * math.log(p / (1 - p)))))
        rows.append((p, float(rng.random() < q)))
    a, b, converged, n = models.logistic_calibration(spark.createDataFrame(rows + [(None, 1.0), (0.5, None)], "p double, y double"))
    assert converged and n == 6000 and abs(a - 0.4) < 0.1 and abs(b - 0.6) < 0.06
    score = [sum((y - 1 / (1 + math.exp(-(a + b * math.log(p / (1 - p)))))) * x for (p, y), x in ((r, 1 if k == 0 else math.log(r[0] / (1 - r[0]))) for r in rows)) for k in (0, 1)]
    assert all(abs(s) < 1e-4 for s in score)  # the gradient is zero


@pytest.mark.parametrize("rows", [[(0.1, 0.0), (0.2, 0.0), (0.8, 1.0), (0.9, 1.0)], [(0.1, 0.0), (0.9, 0.0)], [(0.3, 1.0), (0.3, 0.0)], [], [(0.0, 0.0), (1.0, 1.0)]])
def test_separated_equal_and_no_forecasts_do_not_converge(spark, rows):
    a, b, converged, n = models.logistic_calibration(spark.createDataFrame(rows, "p double, y double"))
    assert not converged and n == (len(rows) if rows else 0) and math.isfinite(a) and math.isfinite(b)


def plain_boost(rows, features, edges, bins, base, trees, depth, rate, penalty, least):
    """Row by row, with the same rule of ties."""
    own = [[min(bins - 1, max(0, math.floor((x[f] - edges[f][0]) / edges[f][1]))) if x[f] is not None else bins for f in features] for x in rows]
    y, margin, out = [x["y"] for x in rows], [base] * len(rows), []

    def grow(inside, level):
        p = {i: 1 / (1 + math.exp(-margin[i])) for i in inside}
        g, h = sum(y[i] - p[i] for i in inside), sum(p[i] * (1 - p[i]) for i in inside)
        best = None
        if level < depth:
            for f in range(len(features)):
                for at in range(bins):
                    left = [i for i in inside if own[i][f] <= at]
                    if len(left) < least or len(inside) - len(left) < least:
                        continue
                    gl, hl = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
                    gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, f, at)
        if best is None:
            return rate * g / (h + penalty)
        _, f, at = best
        return (features[f], at, grow([i for i in inside if own[i][f] <= at], level + 1), grow([i for i in inside if own[i][f] > at], level + 1))

    def value(node, i):
        while isinstance(node, tuple):
            node = node[2] if own[i][features.index(node[0])] <= node[1] else node[3]
        return node

    for _ in range(trees):
        tree = grow(list(range(len(rows))), 0)
        out.append(tree)
        margin = [m + value(tree, i) for i, m in enumerate(margin)]
    return out, margin


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(b, tuple) and abs(a - b) < 1e-9


def test_boosting_equals_the_plain_version(spark):
    rng = random.Random(7)
    rows = [{"i": i, "a": rng.random(), "b": rng.choice([None, 1.0, 2.0, 5.0]), "c": float(rng.randrange(9))} for i in range(300)]
    for x in rows:
        x["y"] = float(rng.random() < (0.8 if x["a"] > 0.6 and x["c"] < 4 else 0.15 if x["b"] is not None else 0.5))
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "i long, a double, b double, c double, y double").repartition(4)
    model = models.boost(df, ["a", "b", "c"], "y", trees=3, depth=2, bins=8, least_rows=5)
    want, margin = plain_boost(rows, ["a", "b", "c"], model.edges, 8, model.base, 3, 2, 0.3, 1.0, 5)
    assert all(same(x, y) for x, y in zip(model.trees, want, strict=True)) and any(isinstance(t, tuple) for t in want)
    got = {r.i: r.q for r in df.select("i", model.predict().alias("q")).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-m))) < 1e-9 for i, m in enumerate(margin))
    table = model.table()
    assert len(table) == sum(1 for t in table if t[4] is not None) * 2 - 3
    assert models.boost(df.limit(0), ["a"], "y", trees=1).trees == [0.0]


def test_boosting_learns_what_the_rate_cannot(spark):
    got = {r.model: r for r in plans.boosted_forecast(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"beta_rate", "calibrated", "boosted"} and len({r.n for r in got.values()}) == 1
    assert got["boosted"].log_loss < got["beta_rate"].log_loss and got["calibrated"].log_loss < got["beta_rate"].log_loss
