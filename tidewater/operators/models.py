"""Models fitted by aggregates: logistic calibration by Newton steps, gradient boosting by histograms.

Only sums reach the driver: five numbers for a Newton step, and for a level of a tree
a number of sums that nodes, features and bins bound.  Models are small values, and
inference is an expression over the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Forecasts are kept so far from 0 and 1, Newton steps and their number.
CLIP, MOST_STEP, STEPS = 1e-6, 4.0, 8
#: The last step of a fit that has converged is smaller.
TOLERANCE = 1e-6


def log_odds(p: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.ln(inside / (1 - inside))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_calibration(forecasts: DataFrame, p: str = "p", y: str = "y", steps: int = STEPS) -> tuple[float, float, bool, int]:
    """(intercept, slope, converged, n) of the log odds of ``y`` over those of ``p``; (0, 1) is a calibrated forecast.

    Each Newton step is one aggregate over the different forecasts; steps longer than ``MOST_STEP``
    are cut.  Where outcomes are separated (or all alike) the fit grows by such steps and does not converge; where all
    forecasts are equal the slope is open, so it stays at (0, 1) and does not converge.  Rows with a null take no part.
    """
    known = forecasts.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    cells = durable(known.groupBy(log_odds(F.col(p)).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits")))
    a, b, last, n = 0.0, 1.0, math.inf, 0
    for _ in range(steps):
        mu = sigmoid(F.lit(a) + F.lit(b) * F.col("x"))
        off, weight = F.col("hits") - F.col("n") * mu, F.col("n") * mu * (1 - mu)
        x = F.col("x")
        s = cells.agg(F.sum(off).alias("g0"), F.sum(off * x).alias("g1"), F.sum(weight).alias("h00"), F.sum(weight * x).alias("h01"), F.sum(weight * x * x).alias("h11"), F.sum("n").alias("n")).first()
        n = s.n or 0
        det = (s.h00 * s.h11 - s.h01 * s.h01) if n else 0.0
        if det <= 1e-9 * max(1.0, n):
            break
        da = max(-MOST_STEP, min(MOST_STEP, (s.h11 * s.g0 - s.h01 * s.g1) / det))
        db = max(-MOST_STEP, min(MOST_STEP, (s.h00 * s.g1 - s.h01 * s.g0) / det))
        a, b, last = a + da, b + db, max(abs(da), abs(db))
    return a, b, last < TOLERANCE, n


def calibrated(p: Column, fit: tuple[float, float, bool, int]) -> Column:
    return sigmoid(F.lit(fit[0]) + F.lit(fit[1]) * log_odds(p))


#: A leaf is its value, a split (feature, bin, left, right): rows up to and with the bin go left.
Node = float | tuple


@dataclass
class Boosted:
    """Trees over binned features: ``edges`` has each feature's least value and the width of its bins."""

    edges: dict[str, tuple[float, float]]
    bins: int
    base: float
    trees: list[Node] = field(default_factory=list)

    def bin(self, feature: str) -> Column:
        """The bin of a value; values outside go to the outer bins, a null or NaN to one of its own behind all others."""
        low, width = self.edges[feature]
        x = F.col(feature).cast("double")
        at = F.floor((x - low) / width) if width > 0 else F.lit(0)
        inside = F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), at)).cast("int")
        return F.when(x.isNull() | F.isnan(x), F.lit(self.bins)).otherwise(inside)

    def margin(self, trees: list[Node] | None = None) -> Column:
        out = F.lit(self.base)
        for tree in self.trees if trees is None else trees:
            out = out + expression(tree, self.bin)
        return out

    def predict(self) -> Column:
        return sigmoid(self.margin())

    def table(self) -> list[tuple]:
        """(tree, node, feature, bin, value) of all nodes; a node's children are 2 n and 2 n + 1."""
        out = []
        for k, tree in enumerate(self.trees):
            stack = [(1, tree)]
            while stack:
                n, node = stack.pop()
                if isinstance(node, tuple):
                    out.append((k, n, node[0], node[1], None))
                    stack += [(2 * n, node[2]), (2 * n + 1, node[3])]
                else:
                    out.append((k, n, None, None, node))
        return sorted(out, key=lambda r: r[:2])


def expression(node: Node, bin_of) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, at, left, right = node
    return F.when(bin_of(feature) <= at, expression(left, bin_of)).otherwise(expression(right, bin_of))


def best_split(histogram: dict[str, list[tuple[float, float, int]]], penalty: float, least_rows: int) -> tuple | None:
    """(gain, feature, bin) with the greatest gain over sums (gradient, Hessian, rows) by bin; of equal ones the first feature and bin."""
    best = None
    for feature, bins in histogram.items():
        g, h, n = (sum(b[k] for b in bins) for k in range(3))
        gl = hl = nl = 0
        for at, (dg, dh, dn) in enumerate(bins[:-1]):
            gl, hl, nl = gl + dg, hl + dh, nl + dn
            if nl < least_rows or n - nl < least_rows:
                continue
            gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = (gain, feature, at)
    return best


def boost(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, penalty: float = 1.0, least_rows: int = 20) -> Boosted:
    """Gradient boosting for a 0/1 label, a level of a tree at a time.

    Rows are folded to cells of equal bins and labels once; each level is one aggregate of gradients
    by node, feature and bin.  Rows without a label take no part; without any, the model is even odds.
    """
    known = rows.filter(F.col(label).isNotNull())
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    ranges = known.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("hits"), *[g(value(f)).alias(f"{k}_{i}") for i, f in enumerate(features) for k, g in (("lo", F.min), ("hi", F.max))]).first()
    edges = {f: (ranges[f"lo_{i}"] or 0.0, ((ranges[f"hi_{i}"] or 0.0) - (ranges[f"lo_{i}"] or 0.0)) / bins) for i, f in enumerate(features)}
    share = min(max((ranges.hits or 0) / ranges.n, CLIP), 1 - CLIP) if ranges.n else 0.5
    model = Boosted(edges, bins, math.log(share / (1 - share)))
    names = {f: f"_b{i}" for i, f in enumerate(features)}
    cells = known.select(*[model.bin(f).alias(c) for f, c in names.items()], F.col(label).cast("double").alias("_y")).groupBy(*names.values()).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_hits"))
    cells = durable(cells.withColumn("_m", F.lit(model.base)))
    bin_of = lambda f: F.col(names[f])
    for _ in range(trees):
        p = sigmoid(F.col("_m"))
        graded = cells.withColumns({"_g": F.col("_hits") - F.col("_n") * p, "_h": F.col("_n") * p * (1 - p)})
        tree: dict[int, tuple | None] = {1: None}  # node -> split, None while open
        values: dict[int, float] = {}
        for level in range(depth + 1):
            front = [n for n in tree if n.bit_length() == level + 1]
            if not front:
                break
            node = _node_column(tree, 1, bin_of)
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("b")) for i, c in enumerate(names.values())]))
            sums = graded.withColumn("_node", node).filter(F.col("_node").isin(front)).select("_node", each.alias("_x"), "_g", "_h", "_n").groupBy("_node", "_x").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.sum("_n").alias("n")).collect()
            held = {n: {f: [(0.0, 0.0, 0)] * (bins + 1) for f in features} for n in front}
            for r in sums:
                held[r._node][features[r._x.f]][r._x.b] = (r.g, r.h, r.n)
            for n in front:
                first = held[n][features[0]]
                g, h = sum(x[0] for x in first), sum(x[1] for x in first)
                values[n] = rate * g / (h + penalty)
                split = best_split(held[n], penalty, least_rows) if level < depth else None
                if split:
                    tree[n] = split[1:]
                    tree[2 * n] = tree[2 * n + 1] = None
        whole = _nested(tree, values, 1)
        model.trees.append(whole)
        cells = durable(cells.withColumn("_m", F.col("_m") + expression(whole, bin_of)))
    return model


def _node_column(tree: dict, n: int, bin_of) -> Column:
    split = tree.get(n)
    if split is None:
        return F.lit(n)
    return F.when(bin_of(split[0]) <= split[1], _node_column(tree, 2 * n, bin_of)).otherwise(_node_column(tree, 2 * n + 1, bin_of))


def _nested(tree: dict, values: dict[int, float], n: int) -> Node:
    split = tree.get(n)
    return values[n] if split is None else (*split, _nested(tree, values, 2 * n), _nested(tree, values, 2 * n + 1))
