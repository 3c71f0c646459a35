"""Document quality by Bradley-Terry ranking of pairs.

Each text has a short vector of measures of form.  Preference pairs are made of
all labelled rows, each poor text against several good ones and each good one against a poor one;
the chance that one is preferred is the logistic curve of the difference of
their scores, and the score is linear in the measures, so the weights are
learned by logistic loss on feature differences.  The threshold is the quantile
of all labelled rows' scores that leaves as many below as are labelled poor; the
returned score is shifted so that it reads ``THRESHOLD`` there.

Pairs lie dealt over the executors.  A step of the training is one pass over them that sums
the loss's slope and bend, so the driver sees these sums only; texts aren't shuffled.

Words are runs of anything but ASCII white space.  A null or empty text has
none: its measures are 0.  Without pairs every text scores one half.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common
from . import labelled, words
from .line_dedup import _SOLID

THRESHOLD = 0.3
#: Good texts that each poor one is compared with.
OPPONENTS = 12
DECAY = 1e-3
MEASURES = ["length", "symbols", "exclamations", "bars", "capitals", "digits", "variety", "echo", "phrases", "lines", "word_length", "stops"]


def _class(members: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members.encode())] = True
    return table


_SYMBOL, _SHOUT, _BAR, _DIGIT, _STOP = _class("#*$%&<>"), _class("!?"), _class("|"), _class("0123456789"), _class(".,;:")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each owner."""
    if not len(owner):
        return np.zeros(n)
    mixed = (value ^ (owner.astype(np.uint64) * np.uint64(words.BASE))) * np.uint64(0xBF58476D1CE4E5B9)
    _, one = np.unique(mixed ^ (mixed >> np.uint64(31)), return_index=True)
    return np.bincount(owner[one], minlength=n)


def measures(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``MEASURES`` for each text; all between 0 and a small number, whatever the length."""
    n = len(at) - 1
    if not len(raw):
        return np.zeros((n, len(MEASURES)))
    starts, ends = words.spans(_SOLID[raw], at)
    first = words.per_text(starts, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    some = np.maximum(1, count)

    def share(table: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(table[raw])
        return np.diff(np.searchsorted(places, at))

    hashed = words.hashes(raw.astype(np.uint16) + np.uint16(1), starts, ends)
    inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    echo = np.bincount(owner[1:][inner & (hashed[1:] == hashed[:-1])], minlength=n) if len(owner) else np.zeros(n)
    three = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    grams = (hashed[:-2] * np.uint64(31) + hashed[1:-1]) * np.uint64(1000003) + hashed[2:] if len(owner) > 2 else np.zeros(0, np.uint64)
    n_grams = np.maximum(1, count - 2)
    phrases = 1 - _distinct(owner[: len(three)][three], grams[three], n) / n_grams
    phrases[count < 3] = 0
    begins = np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1]))
    begins = begins[begins < len(raw)]
    line_first = np.searchsorted(starts, begins)
    line_last = np.append(line_first[1:], len(starts))
    real = line_last > line_first
    line_owner = (np.searchsorted(at, begins, side="right") - 1)[real]
    line_hash = words.hashes(raw.astype(np.uint16) + np.uint16(1), starts[line_first[real]], ends[line_last[real] - 1])
    n_lines = np.maximum(1, np.bincount(line_owner, minlength=n))
    upper, lower = share(_UPPER), share(_LOWER)
    columns = [
        np.log1p(count) / 10,
        np.minimum(share(_SYMBOL) / some, 3),
        np.minimum(share(_SHOUT) / some, 3),
        np.minimum(share(_BAR) / some, 3),
        upper / np.maximum(1, upper + lower),
        np.minimum(share(_DIGIT) / some, 3),
        1 - _distinct(owner, hashed, n) / some,
        echo / some,
        phrases,
        1 - _distinct(line_owner, line_hash, n) / n_lines,
        np.minimum(np.bincount(owner, ends - starts, minlength=n) / some / 10, 3),
        np.minimum(share(_STOP) / some, 1),
    ]
    out = np.stack(columns, axis=1)
    out[count == 0] = 0
    return out


def pair_sums(difference: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of pairs, and the sums of the slopes and bends of their log-likelihood at ``weights``."""
    p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
    return len(p), difference.T @ (1 - p), (difference * (p * (1 - p))[:, None]).T @ difference


def newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], width: int, steps: int = 30) -> np.ndarray:
    """Weights of least loss with decay, by damped Newton steps over ``sums`` of all pairs."""
    w = np.zeros(width)
    for _ in range(steps):
        n, slope, bend = sums(w)
        step = np.linalg.solve(bend / n + DECAY * np.eye(width), slope / n - DECAY * w)
        w += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return w


class Ranking:
    """Weights of the measures, and the score that lies at the threshold."""

    def __init__(self, weights: np.ndarray, cut: float, slope: float = 1.0) -> None:
        self.weights, self.cut, self.slope = weights, cut, slope

    @classmethod
    def even(cls, width: int) -> Ranking:
        """One half for every text."""
        return cls(np.zeros(width), np.log(THRESHOLD / (1 - THRESHOLD)))

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, steps: int = 30, seed: int = 1) -> Ranking:
        """Of rows in memory, with drawn opponents; ``fit`` below is for tables."""
        good, poor = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(poor):
            return cls.even(rows.shape[1])
        rng = np.random.default_rng(seed)
        scale = rows.std(axis=0) + 1e-6
        # the poor text loses to each opponent, and each good text meets a poor one
        winners = np.concatenate([rng.choice(good, len(poor) * OPPONENTS), good])
        losers = np.concatenate([np.repeat(poor, OPPONENTS), rng.choice(poor, len(good))])
        difference = (rows[winners] - rows[losers]) / scale
        w = newton(lambda w: pair_sums(difference, w), rows.shape[1], steps) / scale
        scores = rows @ w
        return cls(w, float(np.quantile(scores, len(poor) / len(labels))))

    def score(self, rows: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights - self.cut + shift, -40, 40)))


def of_column(column: pa.Array) -> np.ndarray:
    data, offsets = common.raw_texts(column)
    whole = np.frombuffer(data, dtype=np.uint8)
    parts = [measures(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in common.chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))


def measured(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, value: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, measures)`` of all labelled rows whose crc32(id) modulo ``modulus`` is not ``value``; of repeated rows each counts."""
    known, texts = labelled.known(docs, labels, label, modulus, value, id_col, text_col)
    kind = dict(texts.dtypes)["id"]
    rows = common.map_arrow(texts, lambda batch: {"id": batch.column(0), "measures": _lists(of_column(batch.column(1)))}, f"id {kind}, measures array<double>")
    return rows.join(known.hint("merge"), "id").select("id", "label", "measures")


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(1, width)), pa.int32()), pa.array(rows.reshape(-1)))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def pairs(rows: DataFrame, poor: int, good: int) -> DataFrame:
    """``(difference)`` of measures, better minus worse, of ``rows`` (label, measures, number), the poor ones numbered first.

    The ``OPPONENTS`` good texts of a poor one are the next ones in their order, so all take part equally often but for one.
    """
    low = rows.filter("label = 0").select(F.col("number").alias("p"), F.col("measures").alias("low"))
    high = rows.filter("label = 1").select((F.col("number") - poor).alias("g"), F.col("measures").alias("high"))
    each = F.transform(F.sequence(F.lit(0), F.lit(OPPONENTS - 1)), lambda k: F.pmod(F.col("p") * OPPONENTS + k, F.lit(good)))
    several = low.select("low", F.explode(each).alias("g")).join(high.hint("merge"), "g")
    one = high.select("high", F.pmod("g", F.lit(poor)).alias("p")).join(low.hint("merge"), "p")
    return several.select("high", "low").unionByName(one.select("high", "low")).select(F.zip_with("high", "low", lambda a, b: a - b).alias("difference"))


def _summed(met: DataFrame, weights: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """``pair_sums`` over all rows of ``met``."""

    def rows(batch: pa.RecordBatch) -> dict:
        n, slope, bend = pair_sums(_rows(batch.column(0)) / scale, weights)
        return {"sums": [np.concatenate([[n], slope, bend.ravel()])]}

    parts = common.map_arrow(met, rows, "sums array<double>").select(F.posexplode("sums").alias("k", "x"))
    out = np.zeros(1 + len(weights) + len(weights) ** 2)
    for r in parts.groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out[0], out[1 : 1 + len(weights)], out[1 + len(weights) :].reshape(len(weights), -1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, value: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """A ranking learned from all labelled rows whose crc32(id) modulo ``modulus`` is not ``value``, and the threshold of their scores."""
    width = len(MEASURES)
    found = measured(docs, labels, label, modulus, value, id_col, text_col).withColumn("order", F.xxhash64(F.col("id").cast("string")))
    rows = common.numbered(found, ["label", "order", "id"], ["measures"])
    sizes = dict(map(tuple, rows.groupBy("label").agg(F.count("*")).collect()))
    poor, good = sizes.get(0, 0), sizes.get(1, 0)
    if not poor or not good:
        return Ranking.even(width)
    scale = np.full(width, 1e-6)
    for r in rows.select(F.posexplode("measures").alias("k", "x")).groupBy("k").agg(F.stddev_pop("x").alias("x")).collect():
        scale[r.k] += r.x
    met = common.durable(pairs(rows, poor, good))
    # the order of sums differs from run to run in the last digits
    weights = np.round(newton(lambda w: _summed(met, w, scale), width), 7) / np.array([float(f"{s:.9g}") for s in scale])
    scores = common.map_arrow(rows.select("measures", "number"), lambda batch: {"score": _rows(batch.column(0)) @ weights, "row": batch.column(1)}, "score double, row long")
    # by row after score, so that equal scores of many copies are dealt to several tasks
    near = common.numbered(scores, ["score", "row"], []).filter(F.col("number").isin(poor - 1, poor)).orderBy("number").collect()
    below, above = near[0].score, near[-1].score
    common.release()
    # equal scores, which rounding may tell apart, are on one side
    return Ranking(weights, below + (above - below) * (1 - poor / (poor + good)) - 1e-9)


def score(docs: DataFrame, ranking: Ranking, name: str = "quality_score", text_col: str = "text") -> DataFrame:
    """``docs`` and a double column ``name``, higher for better texts.

    One pass, no shuffle.  Each row is judged by its own text, so repeated rows
    have equal scores and a very long text is one row's work.  If ``docs`` has a
    column ``name``, it stays and the new one, the last, gets underscores before
    its name.
    """
    name = common.free_name(docs, name)
    held = common.free_name(docs, "_ranked")
    found = common.append_struct(docs, lambda batch: [{"score": x} for x in ranking.score(of_column(batch.column(0).cast(pa.string()))).tolist()], [text_col], "score double", held)
    return found.withColumn(name, F.col(f"{held}.score")).drop(held)
