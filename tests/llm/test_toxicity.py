"""The toxicity classifier on small labelled tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import labelled, subwords, toxicity

BAD = ["grubbly", "snortface", "mudbrain"]


def corpus(n=360, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ["lo", "ri", "ta", "mé", "su", "pla", "dor"] for b in ["ne", "lta", "ris", "go", "mü", "ntal"]]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in scores[labels == 1] for b in scores[labels == 0]]))


def test_held_out_accuracy_and_unseen_spellings(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("clash")).withColumn("_scored", F.lit(1))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score(docs, model, "score").withColumn("held", labelled.held_out("doc_id", 3, 1)).collect()
    held = [(r.score, dict(labels)[r.doc_id]) for r in found if r.held]
    assert 80 < len(held) < 160 and auc(*zip(*held)) > 0.95
    assert found[0].toxicity == "clash" and all(0 <= r.score <= 1 for r in found)
    plain, varied = model.score([b"rine talta plago surine loris dorgo", b"rine talta Snortfaces plago surine gruubbly loris dorgo"])
    assert varied > plain + 0.3


def test_defined_results_for_odd_rows(spark):
    rows, labels = corpus(80)
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x " * 60000), (902, "x " * 60000), (None, "loris")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (903, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, table), "s").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.s)
    assert len(got) == 85 and by[900] == by[901] and by[902][0] == by[902][1]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), table), "s").count() == 0
    alone = toxicity.fit(docs, table.filter("toxic = 0"))
    assert {round(r.s, 9) for r in toxicity.score(docs, alone, "s").collect()} == {round(r, 9) for r in alone.score([b""])}
    assert toxicity.clean(docs, alone).count() == 85


def test_ngrams_of_words():
    got, begin = subwords.buckets([b"ab", "né".encode(), b"ab"])
    # <ab> has <ab, ab> and itself
    assert np.diff(begin).tolist() == [3, 3, 3] and got[:3].tolist() == got[6:].tolist()
