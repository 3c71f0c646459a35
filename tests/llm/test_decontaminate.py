"""Decontamination against a plain search for every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate as de
from tidewater.llm.suffix_automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow(docs, items, window=10):
    wanted = {}
    for item, text in items:
        ws = WORD.findall(fold(text))
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            wanted.setdefault(tuple(ws[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        ws = WORD.findall(fold(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                items_here = wanted.get(tuple(ws[i : i + size]))
                if items_here:
                    hit.update(range(i, i + size))
                    found |= items_here
        out.append((doc, len(ws), len(hit), sorted(found)))
    return out


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "a1", "日本", "x", "yy", "zé"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ", ", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([12, 15, 30]))) for i in range(12)] + [(20, "yy yy yy x"), (21, "q"), (22, ""), (23, None), (24, "日本 é the of x yy zé a1 a1")]
    docs = [(i, text(rng.choice([0, 5, 20, 60])) + (rng.choice(items)[1] or "") + text(rng.choice([0, 3]))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "q"), (103, items[0][1] + "?" + items[0][1]), (104, "word " * 3000 + items[1][1]), (104, "q q")]
    return docs, items + items[:2]


@pytest.mark.parametrize("block_chars", [de.BLOCK_CHARS, 400])
def test_hits_equal_plain_search(spark, block_chars):
    docs, items = fixture(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("overlap", F.lit("clash"))
    got = de.overlaps(df, spark.createDataFrame(items, "item_id long, text string"), "found", block_chars=block_chars).collect()
    assert sorted((r.doc_id, r.found.n_words, r.found.n_hit, r.found["items"]) for r in got) == sorted(slow(docs, items))


def test_cut_spans_and_dropped_documents(spark):
    item = "One two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it é. {item}! After that comes more clean text than the item had words in it, é."), (2, item), (3, "clean text"), (4, None)]
    got = de.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "Before it é.  ! After that comes more clean text than the item had words in it, é."), (3, "clean text"), (4, "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.overlap.n_hit for r in de.overlaps(docs, none).collect()] == [0]
    assert de.overlaps(docs.limit(0), none).count() == 0
    assert de.decontaminate(docs, none).collect()[0].text == "a b"


def test_automaton_knows_all_substrings():
    rng = random.Random(1)
    for _ in range(60):
        items = [(i, [rng.randrange(3) for _ in range(rng.randrange(1, 12))]) for i in range(4)]
        automaton = SuffixAutomaton.of(items)
        holds = lambda s, q: any(q == s[k : k + len(q)] for k in range(len(s)))
        text = [rng.randrange(4) for _ in range(30)]
        for end, (at, size) in enumerate(automaton.matches(text), start=1):
            assert size == max(n for n in range(end + 1) if any(holds(s, text[end - n : end]) for _, s in items))
            for n in range(1, size + 1):
                assert automaton.items[automaton.suffix(at, n)] == {i for i, s in items if holds(s, text[end - n : end])}


def test_frozen_automaton_walks_like_the_growing_one():
    rng = random.Random(2)
    for _ in range(60):
        items = [(i, [rng.randrange(4) for _ in range(rng.randrange(1, 15))]) for i in range(5)]
        growing = SuffixAutomaton.of(items, 2)
        frozen = growing.frozen()
        text = [rng.randrange(-1, 5) for _ in range(40)]
        assert list(frozen.matches(text)) == list(growing.matches(text))
        for at, size in frozen.matches(text):
            for n in range(2, size + 1):
                assert frozen.items[frozen.suffix(at, n)] == growing.items[growing.suffix(at, n)]


def test_many_passes_null_ids_and_clashing_names(spark, monkeypatch):
    docs, items = fixture(6)
    monkeypatch.setattr(de, "PASS_BLOCKS", 2)
    common = " ".join(f"both{i}" for i in range(12))
    items = [*items, (None, common), (77, common), (None, "alone none of these words is anywhere else in any item at all")]
    docs = [*docs, (200, f"x {common} y"), (201, items[-1][1] + " end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("overlap", F.lit("clash")).withColumn("_next", F.lit(1))
    got = de.overlaps(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    assert got.columns == ["doc_id", "text", "overlap", "_next", "_overlap"]
    want = [(i, n, h, [x for x in found if x != "None"]) for i, n, h, found in slow(docs, items)]
    assert sorted((r.doc_id, r._overlap.n_words, r._overlap.n_hit, r._overlap["items"]) for r in got.collect()) == sorted(want)
    assert any(h and not found for _, _, h, found in want)


@pytest.mark.parametrize("tables", ["fixture", "sf0.001"])
def test_query_equals_its_statement(spark, tmp_path, tables):
    duckdb = pytest.importorskip("duckdb")
    from tidewater.llm.q10_decontaminate import ORACLE, op10_decontaminate

    folder = f"/root/testdata/{tables}"
    if tables == "fixture":
        docs, items = fixture(9)
        docs = [(k, text) for k, (_, text) in enumerate(docs)]
        folder = str(tmp_path)
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{'/*.parquet' if tables == 'fixture' else ''}'")
    want = con.execute(ORACLE["op10_decontaminate"])
    names = [c[0] for c in want.description]
    got = op10_decontaminate(spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
