"""The scores of op4_toxicity and op7_quality_ranking against plain Python, row by row, and their training against its own loss."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import ranking, subwords, toxicity, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
FULL = (1 << 64) - 1


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def bucket(piece):
    h = sum(b * pow(words.BASE, i, 1 << 64) for i, b in enumerate(piece.encode())) & FULL
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & FULL
    return (h ^ h >> 32) >> (64 - subwords.BITS)


def plain_word(model, word):
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in range(subwords.LEAST, subwords.MOST + 1) for i in range(len(marked) - n + 1) if n < len(marked)]
    return sum(float(model.table[bucket(g)]) for g in grams) / len(grams)


def plain_score(model, text):
    each = [plain_word(model, w) for w in WORD.findall(lowered(text))]
    raw = model.bias
    if each:
        w = toxicity.WINDOW
        ends = range(min(w, len(each)), len(each) + 1)
        raw += max(sum(each[max(0, e - w) : e]) / max(min(w, e), w / 2) for e in ends) + toxicity.WHOLE * sum(each) / len(each)
    return 1 / (1 + math.exp(-(model.slope * raw + model.shift)))


def texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["Rotten", "rotten!", "fine", "é", "ünfair", "日本", "a1", "the", "|", "#x#", "Good.", "GOOD", "12,5", "t0xic"]
    own = [rng.choice(["", " ", "\n"]).join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(n)]
    return [*own, "", " \n", "same line\nsame line\n\nsame line", "x " * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_is_the_plain_score(seed):
    own = texts(seed)
    model = toxicity.Model.fit(own * 3, [int("otten" in t) for t in own] * 3)
    got = model.score([t.encode() for t in own])
    assert max(abs(a - plain_score(model, t)) for a, t in zip(got, own, strict=True)) < 1e-4
    assert len({round(float(x), 3) for x in got}) > 5


def test_training_lowers_the_loss(monkeypatch):
    rng = random.Random(3)
    own = [" ".join(rng.choice(["calm", "river", "stone", "vile", "vilest"][: 5 if k % 2 else 3]) for _ in range(12)) for k in range(80)]
    y = np.array([k % 2 for k in range(80)])

    def loss(table, bias):
        model = toxicity.Model(table, bias, 1.0, 0.0)
        odds = np.array([bias + sum(plain_word(model, w) for w in t.split()) / len(t.split()) for t in own])
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, odds, -odds)))))

    whole = loss(*toxicity.train([t.encode() for t in own], y))
    monkeypatch.setattr(toxicity, "STEPS", 1)
    assert whole < 0.3 * loss(*toxicity.train([t.encode() for t in own], y))


def plain_measures(text):
    ws, n_bytes = SOLID.findall(text), len(text.encode())
    some = max(1, len(ws))
    if not ws:
        return [0.0] * len(ranking.MEASURES)
    count = lambda members: sum(text.count(c) for c in members)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    three = list(zip(ws, ws[1:], ws[2:]))
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    assert n_bytes
    return [
        math.log1p(len(ws)) / 10,
        min(count("#*$%&<>") / some, 3),
        min(count("!?") / some, 3),
        min(count("|") / some, 3),
        upper / max(1, upper + lower),
        min(count("0123456789") / some, 3),
        1 - len(set(ws)) / some,
        sum(a == b for a, b in zip(ws, ws[1:])) / some,
        1 - len(set(three)) / len(three) if three else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        min(sum(len(w.encode()) for w in ws) / some / 10, 3),
        min(count(".,;:") / some, 1),
    ]


@pytest.mark.parametrize("seed", [3, 4])
def test_quality_is_the_plain_score(seed):
    own = texts(seed)
    rows = ranking.of_column(pa.array(own))
    assert np.allclose(rows, [plain_measures(t) for t in own], atol=1e-9)
    ranks = ranking.Ranking.fit(rows, np.array([k % 3 > 0 for k in range(len(own))], dtype=int))
    shift = math.log(ranking.THRESHOLD / (1 - ranking.THRESHOLD))
    want = [1 / (1 + math.exp(-(sum(a * b for a, b in zip(plain_measures(t), ranks.weights)) - ranks.cut + shift))) for t in own]
    assert np.allclose(ranks.score(rows), want, atol=1e-9)


def test_weights_are_those_of_least_loss():
    rng = np.random.default_rng(1)
    rows, labels = rng.random((60, len(ranking.MEASURES))), np.arange(60) % 3 > 0
    fitted = ranking.Ranking.fit(rows, labels.astype(int), seed=5)
    # the same pairs, and the loss by its definition
    good, poor, draw = np.flatnonzero(labels), np.flatnonzero(~labels), np.random.default_rng(5)
    winners = np.concatenate([draw.choice(good, len(poor) * ranking.OPPONENTS), good])
    losers = np.concatenate([np.repeat(poor, ranking.OPPONENTS), draw.choice(poor, len(good))])
    scale = rows.std(axis=0) + 1e-6
    difference = (rows[winners] - rows[losers]) / scale
    loss = lambda w: float(np.mean(np.log1p(np.exp(-(difference @ w))))) + ranking.DECAY / 2 * float(w @ w)
    best = fitted.weights * scale
    for k in range(len(best)):
        for step in (1e-3, -1e-3):
            moved = best.copy()
            moved[k] += step
            assert loss(moved) > loss(best)


def test_hashes_in_blocks_are_those_of_the_whole(monkeypatch):
    raw = np.frombuffer(("one two three 日本 " * 400 + "x" * 5000 + " end").encode(), dtype=np.uint8)
    starts, ends = words.spans(np.where(raw == 32, 0, raw), np.array([0, len(raw)]))
    whole = words.hashes(raw, starts, ends)
    for block in (7, 100, 4096):
        monkeypatch.setattr(words, "BLOCK", block)
        assert (words.hashes(raw, starts, ends) == whole).all()
