"""Line dedup against a plain search for every repeated run."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import line_dedup as ld


def slow(docs, least):
    """Lines to delete by trying all runs at all earlier places."""
    rows = []
    for i, text in docs:
        lines = [(k, " ".join(x.split()) and x.strip(" \t\n\x0b\x0c\r"), len(x.split())) for k, x in enumerate((text or "").split("\n"))]
        rows.append((i, [x for x in lines if x[2]]))
    first = {}
    for i, lines in rows:
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x[1] for x in lines[a : b + 1])
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    place = (i, lines[a][0], lines[b][0])
                    first[run] = min(first.get(run, place), place)
    out = []
    for i, lines in rows:
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x[1] for x in lines[a : b + 1])
                least_place = first.get(run)
                if least_place and (least_place[0] != i or lines[a][0] > least_place[2]):
                    gone.update(range(lines[a][0], lines[b][0] + 1))
        out.append((i, sorted(gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["é", "of", "x", "日本"]) + str(rng.randrange(9)) for _ in range(rng.choice([1, 2, 3, 6, 12]))) for _ in range(25)]
    passage = [rng.choice(pool) for _ in range(5)]
    docs = []
    for i in range(60):
        lines = [rng.choice(pool + ["", "  "]) + rng.choice(["", " ", "\t"]) for _ in range(rng.choice([0, 1, 3, 9]))]
        if i % 3 == 0:
            lines[1:1] = passage
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[9][1]), (104, "\n".join(["same line here"] * 12)), (105, "w " * 4000 + "\nend")]
    return docs


@pytest.mark.parametrize("least", [6, 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_search(spark, least, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("key", F.lit(3))
    rows = ld.marked(df, "cut", min_words=least).collect()
    got = sorted((r.doc_id, sorted({k for a, b in (r.cut or []) for k in range(a, b + 1)})) for r in rows)
    assert got == sorted(slow(docs, least)) and any(x for _, x in got)
    assert {r.runs for r in rows} == {"clash"}


def test_texts_after_the_cut(spark):
    a, b = "one two three four five six", "seven eight nine ten"
    docs = [(1, f"intro\n{a}\n\n{b}\nend"), (2, f"{a}\n{b}\nother end "), (3, f"{a}\n{b}"), (4, None), (5, ""), (1, f"intro\n{a}\n\n{b}\nend"), (None, "x"), (6, "short\nshort")]
    got = ld.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text is not None) == sorted([("1", docs[0][1])] * 2 + [("2", "other end "), ("5", ""), ("None", "x"), ("6", "short\nshort")])
    assert len(ld.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8, drop_emptied=False).collect()) == 8


def test_empty_table(spark):
    assert ld.dedupe_lines(spark.createDataFrame([], "doc_id long, text string, n int")).columns == ["doc_id", "text", "n"]
    assert ld.dedupe_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_colliding_polynomials_are_not_equal_lines(spark):
    """Two lines of words in Thue-Morse order have one polynomial hash modulo 2**64, whatever the base."""
    order = [bin(i).count("1") & 1 for i in range(4096)]
    first, second = (" ".join("ab"[x ^ flip] for x in order) for flip in (0, 1))
    docs = spark.createDataFrame([(1, first), (2, second), (3, first)], "doc_id long, text string")
    got = ld.dedupe_lines(docs, drop_emptied=False).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, first), (2, second), (3, "")]
