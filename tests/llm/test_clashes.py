"""One rule for result names that a table already has, and repeated rows, for the operators that add a column."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import labelled, licenses, line_dedup, line_quality, pii, ranking, toxicity

TEXT = "Call Nora Blake at +1 202 555 0134 under the MIT license. " * 12


@pytest.mark.parametrize(
    ("name", "add"),
    [
        ("pii", pii.find),
        ("licenses", licenses.scan),
        ("quality", line_quality.judge),
        ("toxicity", lambda d: toxicity.score(d, toxicity.Model.fit(["bad x", "good y"] * 4, [1, 0] * 4))),
        ("quality_score", lambda d: ranking.score(d, ranking.Ranking.fit(ranking.of_column(__import__("pyarrow").array([TEXT, "a"])), __import__("numpy").array([1, 0])))),
        ("runs", line_dedup.marked),
    ],
)
def test_existing_columns_stay(spark, name, add):
    rows = [(1, TEXT), (2, None), (1, TEXT), (3, ""), (4, "é " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(name.upper(), F.lit("own"))
    got = add(docs)
    assert got.columns == ["doc_id", "text", name.upper(), "_" + name]
    found = got.collect()
    assert len(found) == 5 and {r[name.upper()] for r in found} == {"own"}
    same = [r["_" + name] for r in found if r.doc_id == 1]
    assert same[0] == same[1]
    assert add(docs.limit(0)).count() == 0


def test_sample_is_the_same_whatever_the_order(spark):
    rows = [(i % 40, f"text {i % 7} of {i}") for i in range(200)] + [(5, "text"), (5, "text")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    for n, chars in ((1000, 10**6), (30, 10**6), (1000, 300)):
        found = labelled.sample(one, labels, "toxic", 3, 1, rows=n, chars=chars)
        assert found == labelled.sample(two, labels, "toxic", 3, 1, rows=n, chars=chars)
        assert 0 < len(found[0]) <= n and sum(map(len, found[0])) <= chars
    assert labelled.sample(one, labels, "toxic", 3, 1)[0].count("text") in (0, 2)


def test_scores_do_not_depend_on_the_texts_around():
    model = toxicity.Model.fit(["bad x of y", "good y", "so bad", "fine"] * 9, [1, 0, 1, 0] * 9)
    texts = [b"some bad words", b"x" * 50 + b" good", "é bad".encode(), b"", b"bad " * 40]
    alone = [model.score([t])[0] for t in texts]
    assert alone == model.score(texts).tolist() == model.score([b"filler so fine", *texts])[1:].tolist()
