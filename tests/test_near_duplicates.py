"""Near duplicates against all pairs, components against a plain search."""

import random

import pytest

from tidewater.operators import graph, near_duplicates


def plain_components(edges):
    of = {}
    for a, b in edges:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                of[n] = x
    return {n: min(group) for n, group in of.items()}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(90)] + [(7, 500)], "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(70)], "empty": []}[shape]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    want = plain_components([e for e in edges if e[0] != e[1]])
    rows = got.collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("most", [0, 5, 60])
def test_components_by_rounds_until_few_are_left(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "FEW", most)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(70)] + [(500, i) for i in range(100, 190)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    rows = graph.components(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string")).collect()
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in rows} == {f"n{a:03}": f"n{b:03}" for a, b in want.items()} and len(rows) == len(want)


def shingle_set(text):
    own = (text or "").lower().split()
    return {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def texts():
    """Groups of near copies at every similarity, a passage that many share, copies, short, empty and null texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        out += [base] + [changed(rng, base, rng.randrange(0, max(2, len(base) // 25))) for _ in range(6)]
    passage = [word() for _ in range(60)]
    out += [passage + [word() for _ in range(25)] for _ in range(60)]  # a similarity of about 0.5
    out += [passage] * 5 + [changed(rng, passage, 1) for _ in range(5)]
    out += [[], [], ["one"], ["one"], ["one", "two"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)] + [(900, None), (901, "  \n"), (5, "another text of five"), (None, "no id")]
    rng.shuffle(rows)
    return rows


def test_recall_and_precision_against_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS digest").repartition(5)
    got = near_duplicates.near_duplicates(df, "doc_id", "text").collect()
    known = [(i, shingle_set(t)) for i, t in rows if i is not None]
    assert len(got) == len(known)
    links = []
    for x, (i, s) in enumerate(known):
        for y, (j, t) in enumerate(known[:x]):
            if s == t or (s and t and len(s & t) >= 0.8 * len(s | t)):
                links.append((x, y))
    group = plain_components(links)
    by_row = {}
    for k, (i, s) in enumerate(known):
        by_row.setdefault(group.get(k, k), []).append(i)
    want = {(i, min(ids)) for ids in by_row.values() for i in ids}
    same = {(r.id, r.class_id) for r in got} & want
    assert len(same) >= 0.98 * len(want)
    true = {(known[x][0], known[y][0]) for x, y in links}
    cls = {}
    for r in got:
        cls.setdefault(r.id, set()).add(r.class_id)
    found = sum(bool(cls[a] & cls[b]) for a, b in true)
    assert found >= 0.9 * len(true) and len(true) > 150
    # nothing below the similarity is joined but by chains
    assert {(r.id, r.class_id) for r in got} <= want | {(r.id, r.representative) for r in got}
    for r in got:
        assert r.representative == min(i for i, s in known if any(i2 == r.id and s2 == s for i2, s2 in known))


def test_what_no_leader_reaches_is_found_by_the_prefix_filter(spark):
    """One key for all: the links must still connect what all pairs connect."""
    from pyspark.sql import functions as F

    rows = [r for r in texts() if r[0] is not None]
    df = spark.createDataFrame(rows, "id long, text string").dropDuplicates(["id"])
    sets = df.select("id", near_duplicates.shingles(F.col("text")).alias("shingles")).filter(F.size("shingles") > 0).cache()
    keyed = sets.select("id", F.array(F.lit(1).cast("long")).alias("keys"))
    held = {r.id: set(r.shingles) for r in sets.collect()}
    true = [(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])]
    for leaders in (1, 2):
        got = near_duplicates.links(sets, keyed, 0.8, leaders).collect()
        assert plain_components([(r.a, r.b) for r in got]) == plain_components(true)
        assert len(got) < len(held) * 8


def test_what_an_early_leader_took_is_linked_with_what_later_ones_reach(spark):
    """A chain of three in a key of its own: whichever leads, the middle one must be linked with both ends."""
    rows, keys = [], []
    for c in range(12):
        for k in range(3):
            rows.append((c * 3 + k, [c * 1000 + x for x in range(k * 10, k * 10 + 100)]))
            keys.append((c * 3 + k, [c]))
    sets, keyed = spark.createDataFrame(rows, "id long, shingles array<long>"), spark.createDataFrame(keys, "id long, keys array<long>")
    for leaders in (1, 2, 3):
        got = plain_components([(r.a, r.b) for r in near_duplicates.links(sets, keyed, 0.8, leaders).collect()])
        assert got == {i: i - i % 3 for i in range(36)}


def on_disk(spark):
    """Bytes of each file that is written on the way: the shared folder's, and those of shuffles."""
    from pathlib import Path

    from tidewater.session import shared_folder

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = {}
    while files.hasNext():
        f = files.next()
        found[f.getPath()] = f.length()
    own = shared_folder(spark).removeprefix("file:")
    return found | {str(f): f.stat().st_size for f in Path(own).rglob("*") if f.is_file()}


def test_less_is_left_on_disk_than_the_texts_have(spark):
    """Sets of shingles aren't written, and shuffle files go with the query that made them."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(900)] for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*base, *(changed(rng, t, 5) for t in base[:40])])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = on_disk(spark)
    got = near_duplicates.near_duplicates(df, "doc_id", "text")
    added = sum(n for f, n in on_disk(spark).items() if f not in before)
    assert added < sum(len(t) for _, t in rows)
    assert {r.id: r.class_id for r in got.collect()} == {i: i if i < 150 else i - 150 for i in range(190)}


def test_large_groups_are_dealt_to_pairs_of_blocks(spark, monkeypatch):
    """Whatever a task may hold, the classes are the same."""
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    rows = lambda: sorted(map(tuple, near_duplicates.near_duplicates(df, "doc_id", "text").collect()))
    want = rows()
    for name, most in (("GROUP_TEXTS", 3), ("BIN_SHINGLES", 400)):
        monkeypatch.setattr(near_duplicates, name, most)
    assert rows() == want


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_what_leaders_miss_is_met_in_every_block(spark, monkeypatch, blocks):
    """One key with chains that no leader reaches as a whole, and sets that are like none: no pairs are listed."""
    rows = [(c * 100 + k, [c * 10_000 + x for x in range(k * 10, k * 10 + 100)]) for c in range(4) for k in range(25)]
    rows += [(1000 + i, [100_000 + 100 * i + x for x in range(100)]) for i in range(40)]
    sets = spark.createDataFrame(rows, "id long, shingles array<long>")
    keyed = spark.createDataFrame([(i, [7]) for i, _ in rows], "id long, keys array<long>")
    monkeypatch.setattr(near_duplicates, "GROUP_TEXTS", -(-len(rows) // blocks))
    got = near_duplicates.links(sets, keyed, 0.8).collect()
    assert plain_components([(r.a, r.b) for r in got]) == {c * 100 + k: c * 100 for c in range(4) for k in range(25)}
    assert len(got) < len(rows) * (2 + blocks)


@pytest.mark.parametrize("text", ["", " \n", "One", "one two\tthree\vfour\ffive\rsix", "Äpfel ÄPFEL äpfel İ ß " * 3, "a\x1cb c\u00a0d e\u2003f g h i j", "x " * 40, "the same words again and " * 9])
def test_hashes_are_those_of_the_column(spark, text):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "t string").select(near_duplicates.shingles(F.col("t"))).first()[0]
    own = near_duplicates.hashes(text.encode())
    assert own.tolist() == sorted(got)
    factors = near_duplicates.coefficients(65)
    if got:
        assert near_duplicates.signature(own, 65).tolist() == [min((a * (x % near_duplicates.PRIME) + b) % near_duplicates.PRIME for x in got) for a, b in factors]


def test_estimates_of_components_do_not_grow_with_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    found = graph.components(edges.join(edges.select("a"), "a").join(edges.select("b"), "b"))
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 10_000
    assert found.filter("component = 0").count() == 301


def test_empty_table(spark):
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
