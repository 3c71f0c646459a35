"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    label = {f: f for _, f in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    values = list(label)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                label[find(a)] = find(b)
    least = {}
    for i, f in prints:
        least[find(f)] = min(i, least.get(find(f), i))
    return sorted((i, f, least[find(f)]) for i, f in prints)


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["é", "Ünï", "日本"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 40, 200]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append("\n".join(copy))
        if i % 9 == 0:
            rows.append(" ".join(base).upper())
    rows += [None, "", " \t\n", "one", "a b c d e", "x " * 5000]
    return list(enumerate(rows, start=100))


@pytest.mark.parametrize("hot_entry", [512, 2, 0])
@pytest.mark.parametrize("segments", [2, 3, 4])
def test_components_equal_brute_force(spark, hot_entry, segments):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, hot_entry=hot_entry, segments=segments).collect()
    assert sorted((r.id, r.fp % (1 << 64), r.component) for r in got) == slow_components(rows)


def test_links_are_all_close_pairs(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 8]))) for _ in range(80)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert got == want


def test_empty_table_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, None, None)], "doc_id long, text string, fp string").withColumn("id", F.lit(1))
    assert sorted((r.id, r.component) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (1, "A b c d e"), (1, "a b c d e"), (2, "quite another text here now"), (None, "a b c d e"), (None, "z"), (5, None), (6, "")], "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "None", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_segments_by_size():
    assert [simhash.best_segments(n) for n in (200_000, 10_000_000, 1_000_000_000)] == [3, 3, 2]


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one text about rivers and mills"), (1, "a wholly different note on bread"), (2, "one text about rivers and mills"), (7, "same row"), (7, "same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs, docs.repartition(3)):
        assert sorted(r.text[:5] for r in simhash.keep_one(d).collect()) == ["a who", "one t", "same "]


def test_links_of_hot_entries_are_joined_by_sorting(spark):
    """Adaptive execution made tables of a ball's points on the driver."""
    found = simhash.links(spark.createDataFrame([(i,) for i in range(40)], "fp long"), hot_entry=2)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
