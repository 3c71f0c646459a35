"""Near copies at a similarity: fingerprints and groups against plain Python, recall against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import near_copies as nc

FULL = (1 << 64) - 1


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def slow_fingerprint(text, bits=nc.BITS):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    out = b""
    for lane in range(1, bits // 64 + 1):
        mixed = [mix(h ^ lane * 0x9E3779B97F4A7C15 & FULL).to_bytes(8, "little") for h in hashes]
        for byte in range(8):
            out += bytes([sum(1 << b for b in range(8) if hashes and 2 * sum(m[byte] >> b & 1 for m in mixed) > len(hashes))])
    return out


def slow_keys(text):
    """Least hashes of each band, and of each split, as tuples."""
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    factors = [mix(i * 0x9E3779B97F4A7C15 & FULL) | 1 for i in range(1, nc.BANDS * nc.ROWS + nc.SPLITS * nc.SPLIT_ROWS + 1)]
    least = [min((h * f & FULL for h in hashes), default=None) for f in factors]
    cut = nc.BANDS * nc.ROWS
    bands = [(k, *least[k * nc.ROWS : (k + 1) * nc.ROWS]) for k in range(nc.BANDS)]
    return set(bands), {(k, *least[cut + k * nc.SPLIT_ROWS : cut + (k + 1) * nc.SPLIT_ROWS]) for k in range(nc.SPLITS)}


def groups(items, linked):
    """Smallest id of each item's component; ``items`` are (id, value), ``linked`` compares values."""
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if find(i) != find(j) and linked(items[i][1], items[j][1]):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        least[find(i)] = min(key, least.get(find(i), key))
    return [(key, least[find(i)]) for i, (key, _) in enumerate(items)]


def slow_components(rows, bits=nc.BITS, split=False):
    """(id, fingerprint, component) by trying all pairs: links share a key (and a split, with ``split``) and differ in few enough bits."""
    most = nc.limit(nc.SIMILARITY, bits)
    whole = {}
    prints = []
    for i, t in rows:
        f = int.from_bytes(slow_fingerprint(t, bits), "big")
        prints.append((i, f))
        whole[f] = slow_keys(t)
    linked = lambda a, b: a == b or (a ^ b).bit_count() <= most and bool(a and b and whole[a][0] & whole[b][0]) and (not split or bool(whole[a][1] & whole[b][1]))
    return [(i, f, c) for (i, c), (_, f) in zip(groups(prints, linked), prints, strict=True)]


def corpus(seed, n=50):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "Ünï", "日本"]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 40, 150, 300]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, len(copy) // 40 + 1, len(copy) // 10 + 1])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append("\n".join(copy))
        if i % 9 == 0:
            rows.append(" ".join(base).upper())
    rows += [None, "", " \t\n", "one", "a b c d e", "x " * 5000]
    return list(enumerate(rows, start=100))


def test_fingerprints():
    for _, text in corpus(1, 8):
        hashes = nc.shingles((text or "").encode())
        assert nc.fingerprint(hashes) == slow_fingerprint(text)


def test_keys_are_equal_where_least_hashes_are():
    texts = [t for _, t in corpus(6, 12)]
    own = [nc.keys(nc.shingles((t or "").encode())) for t in texts]
    slow = [slow_keys(t) for t in texts]
    for (a, x), s in zip(own, slow):
        for (b, y), u in zip(own, slow):
            if len(a) and len(b):
                assert len(np.intersect1d(a, b)) == len(s[0] & u[0]) and len(np.intersect1d(x, y)) == len(s[1] & u[1])
    assert [len(a) for (a, _), t in zip(own, texts) if not shingles(t)] == [0, 0, 0]


@pytest.mark.parametrize(("hot_entry", "block"), [(64, 32768), (2, 32768), (0, 3)])
def test_groups_equal_plain_ones(spark, hot_entry, block):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    got = nc.near_copies(docs, hot_entry=hot_entry, block=block).collect()
    if hot_entry == 2:  # a key with two nodes is not split: between both
        loose, strict = slow_components(rows), slow_components(rows, split=True)
        of = dict(map(tuple, got))
        least = {i: c for i, _, c in loose}
        assert all(least[i] == least[c] for i, c in of.items()) and all(of[i] == of[c] for i, _, c in strict)
        return
    want = [(i, c) for i, _, c in slow_components(rows, split=hot_entry == 0)]
    assert sorted((r.id, r.component) for r in got) == sorted(want)
    assert any(i != c for i, c in want)


@pytest.mark.parametrize(("words", "changes"), [(40, 3), (300, 24), (1000, 80)])
def test_recall_and_precision_at_the_similarity(words, changes):
    """Pairs with some words replaced: those of 0.8 or more are linked by band, split and distance, those below 0.65 are not."""
    rng = random.Random(4)
    near = found = far = wrong = 0
    for _ in range(300 if words == 1000 else 1200):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy = list(base)
        for _ in range(rng.randrange(1, changes)):
            copy[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        similarity = len(a & b) / len(a | b)
        one, two = (nc.shingles(" ".join(t).encode()) for t in (base, copy))
        x, y = nc.keys(one), nc.keys(two)
        differ = np.bitwise_count(np.frombuffer(nc.fingerprint(one), np.uint8) ^ np.frombuffer(nc.fingerprint(two), np.uint8)).sum()
        linked = differ <= nc.limit() and len(np.intersect1d(x[0], y[0])) and len(np.intersect1d(x[1], y[1]))
        if similarity >= nc.SIMILARITY:
            near, found = near + 1, found + bool(linked)
        elif similarity < 0.65:
            far, wrong = far + 1, wrong + bool(linked)
    assert near > 70 and found / near > 0.95
    assert far > 70 and wrong / far < (0.05 if words == 40 else 0.01)


def test_keys_do_not_grow_with_the_corpus(spark):
    assert nc.rows_for_each_text() == (13, 65)
    docs = spark.createDataFrame([(i, f"text of number {i} and more of it") for i in range(50)], "doc_id long, text string")
    assert {(len(r["keys"]), len(r.splits)) for r in nc.fingerprints(docs).collect()} == {(13, 5)}


def test_walk_connects_what_chains_connect():
    rng = np.random.default_rng(5)
    for _ in range(50):
        prints = rng.integers(0, 2, (30, 64), dtype=np.uint8)
        prints[5:20] = prints[4]
        for k in range(5, 20):
            prints[k, rng.integers(0, 64, 3)] ^= 1
        packed = np.packbits(prints, axis=1)
        a, b = nc.walk(packed, 5)
        got = dict(groups(list(enumerate(range(30))), lambda x, y: bool(((a == x) & (b == y) | (a == y) & (b == x)).any())))
        want = dict(groups(list(enumerate(prints)), lambda x, y: int((x != y).sum()) <= 5))
        assert got == want and len(a) < 30


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "A b c d e"), (1, "a b c d e"), (2, "quite another text here now"), (None, "a b c d e"), (None, "z"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = nc.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "5", "None", "None"]
    assert nc.keep_one(docs.limit(0)).count() == 0


def test_unlike_texts_of_one_id_stay_and_equal_rows_are_one(spark):
    rows = [(1, "one text about rivers and mills", "a"), (1, "a wholly different note on bread", "a"), (2, "one text about rivers and mills", "b"), (7, "same row", "c"), (7, "same row", "c"), (7, "same row", "d"), (8, "solo " * 3000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    want = [sorted(r.text[:5] for r in nc.keep_one(d).collect()) for d in (docs, docs.repartition(3), spark.createDataFrame(rows[::-1], docs.schema))]
    assert want == [["a who", "one t", "same ", "solo "]] * 3
    lang = [r._id for r in nc.keep_one(docs).collect() if r.doc_id == 7]
    assert lang == [r._id for r in nc.keep_one(docs.repartition(5)).collect() if r.doc_id == 7]
