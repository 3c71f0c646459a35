"""Toxicity by a bag of subword embeddings under a linear softmax.

Each hashed character n-gram has an embedding.  A word is the mean of its
n-grams, a text the mean of its words, and a linear softmax of two classes
stands on top; embeddings and softmax are trained jointly by Adam, in numpy, on
a bounded sample of labelled rows.  As an unseen spelling shares most n-grams
with the word it varies, it gets nearly that word's embedding.

A long text may hold few toxic words.  The model is linear in its words, so it
scores any stretch of a text as well as the whole: the raw score is that of the
worst stretch of ``WINDOW`` words plus ``WHOLE`` times that of the whole text.
A logistic curve fitted on rows that were not trained on makes it a
probability.

Words are lower-cased runs of letters, digits and characters beyond ASCII.  A
null or empty text has none and gets the score of the bias alone.  With no
labelled row, or with one class only, every text gets that class's share (one
half without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common
from . import labelled, subwords, words

WIDTH = 4
STEPS = 60
RATE = 0.05
DECAY = 1e-4
SCALE = 20.0
#: Words in fewer labelled texts give no n-grams to the model.
LEAST_TEXTS = 4
WINDOW, WHOLE = 8, 3.0
THRESHOLD = 0.7
#: Word scores that a worker remembers.
REMEMBERED = 500_000
#: Word scores are summed in parts of one 2**24th.
_UNIT = float(1 << 24)


def _fold(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    folded = words.ALNUM[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    starts, ends = words.spans(folded, offsets)
    return folded, starts, ends, words.per_text(starts, offsets)


def _sums(owner: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Column sums of ``weights`` by owner."""
    return np.stack([np.bincount(owner, weights[:, j], minlength=n) for j in range(weights.shape[1])], axis=1).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """The log-odds that each bucket adds, and the bias: all that a linear softmax of two classes needs."""
    table = np.zeros(1 << subwords.BITS, dtype=np.float32)
    share = np.bincount(labels, minlength=2)
    bias = np.log(np.maximum(share, 0.5)).astype(np.float32)
    # words of each text with their counts, a few megabytes of texts at a time
    n, keys, counts, owners, sizes, seen = len(texts), [], [], [], np.zeros(len(texts), np.int64), []
    for i, j in common.chunks(np.append(0, np.cumsum([len(t) for t in texts]))):
        folded, starts, ends, first = _fold(texts[i:j])
        unique, one, number = np.unique(words.hashes(folded, starts, ends), return_index=True, return_inverse=True)
        sizes[i:j] = np.diff(first)
        cells, times = np.unique(np.repeat(np.arange(j - i), sizes[i:j]) * max(1, len(unique)) + number, return_counts=True)
        keys.append(unique[cells % max(1, len(unique))])
        owners.append(i + cells // max(1, len(unique)))
        counts.append(times)
        data = folded.tobytes()
        seen.append((unique, [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]))
    unique, number, spread = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    common_words = spread >= min(LEAST_TEXTS, 1 + n // 20)
    if not common_words.any() or not share.all():
        return table, float(bias[1] - bias[0])
    kept = unique[common_words]
    pieces: list[bytes] = [b""] * len(kept)
    for own, found in seen:
        at = np.minimum(np.searchsorted(kept, own), len(kept) - 1)
        for k in np.flatnonzero(kept[at] == own).tolist():
            pieces[at[k]] = found[k]
    del seen
    place = np.cumsum(common_words) - 1
    text, times = np.concatenate(owners), np.concatenate(counts)
    used, begin = subwords.buckets(pieces)
    used, grams = np.unique(used, return_inverse=True)
    inner = common_words[number]
    weight = (times[inner] / sizes[text[inner]]).astype(np.float32)[:, None] * SCALE
    text, number = text[inner], place[number[inner]]
    sizes = np.diff(begin)
    word_of = np.repeat(np.arange(len(sizes)), sizes)
    # both classes weigh the same
    part = np.where(labels == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)[:, None]
    target = np.eye(2, dtype=np.float32)[labels]
    rng = np.random.default_rng(seed)
    parts = [(rng.standard_normal((len(used), WIDTH)) * 0.1).astype(np.float32), rng.standard_normal((WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
    slow, fast = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        vectors, softmax, shift = parts
        own = np.add.reduceat(vectors[grams], begin[:-1], axis=0) / sizes[:, None].astype(np.float32)
        whole = _sums(text, weight * own[number], n)
        odds = whole @ softmax + shift
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - target) * part
        back = _sums(number, weight * (error @ softmax.T)[text], len(sizes)) / sizes[:, None].astype(np.float32)
        gradients = [_sums(grams, back[word_of], len(used)) + DECAY * vectors, whole.T @ error, error.sum(axis=0)]
        for p, g, m, v in zip(parts, gradients, slow, fast, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    vectors, softmax, shift = parts
    table[used] = vectors @ (softmax[:, 1] - softmax[:, 0]) * SCALE
    return table, float(shift[1] - shift[0])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve of one measure, by damped Newton steps with a little decay."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y) + 1e-3 * w)
        w -= np.clip(step, -1, 1)
    return max(0.0, float(w[0]) / scale), float(w[1])


class Model:
    """What a worker needs to score texts; about a megabyte, whatever the corpus."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int]) -> Model:
        data, y = [t.encode() for t in texts], np.array(labels, dtype=np.int64)
        if len(set(labels)) < 2:
            p = (sum(labels) + 0.5) / (len(labels) + 1)
            return cls(np.zeros(1 << subwords.BITS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
        aside = np.arange(len(y)) % 4 == 3
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), dtype=bool)
        table, bias = train([t for t, a in zip(data, aside, strict=True) if not a], y[~aside])
        own = cls(table, bias, 1.0, 0.0)
        fit = aside if aside.any() else ~aside
        own.slope, own.shift = logistic(own.raw([t for t, a in zip(data, fit, strict=True) if a]), y[fit])
        return own

    def word_scores(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        unique, one, number = np.unique(words.hashes(folded, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        values = np.zeros(len(unique), dtype=np.float32)
        values[known] = self.values[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = folded.tobytes()
            used, begin = subwords.buckets([data[starts[i] : ends[i]] for i in one[fresh]])
            values[fresh] = np.add.reduceat(self.table[used], begin[:-1]) / np.diff(begin)
            if len(self.keys) > REMEMBERED:
                self.keys, self.values = unique, values
            else:
                keys = np.concatenate([self.keys, unique[fresh]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.values = keys[order], np.concatenate([self.values, values[fresh]])[order]
        return values[number]

    def raw(self, texts: list[bytes]) -> np.ndarray:
        parts = [self._raw(texts[i:j]) for i, j in common.chunks(np.append(0, np.cumsum([len(t) for t in texts])))]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _raw(self, texts: list[bytes]) -> np.ndarray:
        folded, starts, ends, first = _fold(texts)
        # whole numbers, so that a text's sums don't depend on the texts before it
        scores = np.rint(self.word_scores(folded, starts, ends).astype(np.float64) * _UNIT).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(scores))
        sizes = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, sizes) / _UNIT
        # a stretch ends at each word; one that is cut by the text's begin counts as half a window at least
        last = np.arange(len(starts)) + 1
        begin = np.maximum(last - WINDOW, np.repeat(first[:-1], sizes))
        full = (last - begin == WINDOW) | (last == np.repeat(first[1:], sizes)) & (begin == np.repeat(first[:-1], sizes))
        stretch = np.where(full, (total[last] - total[begin]) / np.maximum(last - begin, WINDOW / 2) / _UNIT, -np.inf)
        worst = np.zeros(len(texts))
        some = sizes > 0
        if some.any():
            worst[some] = np.maximum.reduceat(stretch, first[:-1][some])
        return worst + WHOLE * mean + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -40, 40)))

    def column(self, column: pa.Array) -> np.ndarray:
        return self.score(list(common.each_text(column)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, value: int = 1, id_col: str = "doc_id", text_col: str = "text", rows: int = labelled.SAMPLE_ROWS) -> Model:
    """A model of at most ``rows`` labelled rows whose crc32(id) modulo ``modulus`` is not ``value``."""
    model = Model.fit(*labelled.sample(docs, labels, label, modulus, value, id_col, text_col, rows))
    common.release()
    return model


def score(docs: DataFrame, model: Model, name: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` and a double column ``name``: the probability that a text is toxic.

    One pass, no shuffle.  Each row is judged by its own text, so repeated rows
    have equal scores and a very long text is one row's work.  If ``docs`` has a
    column ``name``, it stays and the new one, the last, gets underscores before
    its name.
    """
    name = common.free_name(docs, name)
    held = common.free_name(docs, "_scored")
    found = common.append_struct(docs, lambda batch: [{"score": x} for x in model.column(batch.column(0).cast(pa.string())).tolist()], [text_col], "score double", held)
    return found.withColumn(name, F.col(f"{held}.score")).drop(held)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more."""
    name = common.free_name(docs, "toxicity")
    return score(docs, model, name, text_col).filter(F.col(name) < threshold).drop(name)
