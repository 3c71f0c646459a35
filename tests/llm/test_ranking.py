"""The pairwise quality ranking: measures by hand, held-out order and odd rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import labelled, ranking

from .test_toxicity import auc


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ["lo", "ri", "ta", "mé", "su"] for b in ["ne", "lta", "ris", "go", "mü"]]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))]
        if i % 5 == 0:
            text = [[w + "$$#" for w in text], [w.upper() + "!!" for w in text], [text[0]] * len(text)][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 != 0)))
    return rows, labels


def test_measures_by_hand():
    got = dict(zip(ranking.MEASURES, ranking.of_column(pa.array(["Ab ab ab! x1\nAb ab ab! x1\n\nq|é"]))[0]))
    want = {"length": np.log1p(9) / 10, "symbols": 0, "exclamations": 2 / 9, "bars": 1 / 9, "capitals": 2 / 15, "digits": 2 / 9, "variety": 1 - 5 / 9, "echo": 0, "phrases": 1 - 5 / 7, "lines": 1 / 3, "stops": 0}
    assert {k: round(v, 9) for k, v in got.items() if k in want} == {k: round(float(v), 9) for k, v in want.items()}
    assert ranking.of_column(pa.array([None, "", " \n"], pa.string())).any() == False  # noqa: E712


def test_held_out_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality_score", F.lit("clash"))
    ranks = ranking.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = ranking.score(docs, ranks, "score").withColumn("held", labelled.held_out("doc_id", 5, 0)).collect()
    held = [(r.score, dict(labels)[r.doc_id]) for r in found if r.held]
    assert len(held) > 30 and auc(*zip(*held)) > 0.97 and found[0].quality_score == "clash"
    assert np.mean([(s >= ranking.THRESHOLD) == y for s, y in held]) > 0.9


def test_odd_rows(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x " * 60000), (902, "x " * 60000), (None, "loris")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (903, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = ranking.score(docs, ranking.fit(docs, table), "s").collect()
    assert len(got) == 65 and all(0 <= r.s <= 1 for r in got)
    assert ranking.score(docs.limit(0), ranking.fit(docs.limit(0), table), "s").count() == 0
    alone = ranking.fit(docs, table.filter("quality = 1"))
    assert {round(r.s, 9) for r in ranking.score(docs, alone, "s").collect()} == {0.5}


def test_all_labelled_rows_are_learned_from(spark):
    """More rows than a bounded sample: the weights are those of all pairs, and the threshold leaves exactly as many below as are poor."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["Lone", "ri7", "ta!", "mé", "s#", "go."]) * rng.randrange(1, 9) for _ in range(rng.randrange(3, 30)))) for i in range(8100)]
    labels = [(i, int(rng.random() < 0.2 + 0.6 * ("#" not in t[:40]))) for i, t in rows]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ranks = ranking.fit(docs, table)
    own = table.filter(~labelled.held_out("doc_id", 5, 0)).select("doc_id", "quality", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).orderBy("h", "doc_id").collect()
    measured = ranking.of_column(pa.array([rows[r.doc_id][1] for r in own]))
    marks = np.array([r.quality for r in own])
    assert len(own) > labelled.SAMPLE_ROWS
    assert int((ranks.score(measured) < ranking.THRESHOLD).sum()) == int((marks == 0).sum())
    low, high = measured[marks == 0], measured[marks == 1]
    met = [high[(p * ranking.OPPONENTS + k) % len(high)] - low[p] for p in range(len(low)) for k in range(ranking.OPPONENTS)]
    difference = np.array(met + [high[g] - low[g % len(low)] for g in range(len(high))])
    scale = measured.std(axis=0) + 1e-6
    n, slope, _ = ranking.pair_sums(difference / scale, ranks.weights * scale)
    assert n == ranking.OPPONENTS * len(low) + len(high)
    assert np.abs(slope / n - ranking.DECAY * ranks.weights * scale).max() < 1e-6
