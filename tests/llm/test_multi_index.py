"""Multi-index hashing of long fingerprints: tables, recall at the similarity, links against all pairs, and the pipeline's use of it."""

import random

import numpy as np
import pytest

from tidewater.llm import multi_index as mi
from tidewater.llm import near_copies as nc

from .test_near_copies import corpus, groups, shingles


def test_segments():
    got = mi.segments(1000, nc.differing(0.8), 1024)
    assert got.shape == (62, 16) and len(set(got.ravel().tolist())) == got.size
    assert mi.segments(16_000_000, nc.differing(0.8), 1024).shape == (143, 21)
    prints = np.random.default_rng(1).integers(0, 256, (5, 128), dtype=np.uint8)
    own = mi.values(prints, got)
    for r, p in enumerate(prints):
        whole = int.from_bytes(p.tobytes(), "big")
        assert own[r].tolist() == [(k + 1) << 16 | whole >> (1024 - 16 * (k + 1)) & 0xFFFF for k in range(62)]


@pytest.mark.parametrize(("words", "changes", "n"), [(40, 3, 1000), (300, 24, 1000), (300, 24, 16_000_000)])
def test_recall_at_the_similarity(words, changes, n):
    rng = random.Random(4)
    chosen = mi.segments(n, nc.differing(nc.SIMILARITY), nc.BITS)
    near = found = 0
    for _ in range(600):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy = list(base)
        for _ in range(rng.randrange(1, changes)):
            copy[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        if len(a & b) / len(a | b) < nc.SIMILARITY:
            continue
        prints = np.frombuffer(b"".join(nc.fingerprint(nc.shingles(" ".join(t).encode())) for t in (base, copy)), np.uint8).reshape(2, -1)
        x, y = mi.values(prints, chosen)
        bits = np.bitwise_count(prints[0] ^ prints[1])
        linked = (x == y).any() and bits.sum() <= nc.limit() and bits[: mi.SKETCH // 8].sum() <= mi.sketch_limit(nc.limit(), nc.BITS)
        near, found = near + 1, found + bool(linked)
    assert near > 70 and found / near > 0.95


@pytest.mark.parametrize(("hot_entry", "block"), [(32, 32768), (0, 32768), (1, 3)])
def test_links_connect_what_segments_and_distance_connect(spark, hot_entry, block):
    texts = [t for _, t in corpus(2)]
    prints = sorted({nc.fingerprint(nc.shingles((t or "").encode())) for t in texts})
    nodes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fp binary")
    whole = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    own = mi.values(whole, mi.segments(len(prints), nc.differing(nc.SIMILARITY), nc.BITS))
    close = lambda x, y: bool(whole[x].any() and whole[y].any() and (own[x] == own[y]).any()) and int(np.bitwise_count(whole[x] ^ whole[y]).sum()) <= nc.limit()
    got = {(r.a, r.b) for r in mi.links(nodes, nc.limit(), nc.differing(nc.SIMILARITY), nc.BITS, hot_entry, block).collect()}
    items = list(enumerate(range(len(prints))))
    want = dict(groups(items, close))
    assert dict(groups(items, lambda x, y: (x, y) in got or (y, x) in got)) == want
    assert all(close(a, b) for a, b in got) and any(i != c for i, c in want.items())


def test_pipeline_looks_up_segments(spark, monkeypatch, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    seen, plain = [], mi.entries
    monkeypatch.setattr(mi, "entries", lambda nodes, chosen: seen.append(chosen.shape) or plain(nodes, chosen))
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60)) + f" end {i}") for i in range(4)] + [(9, "quite another text")], "doc_id long, text string")
    left = pipeline.without_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [0, 9] and seen == [(62, 16)]


def test_groups_do_not_list_their_pairs():
    """Entries of 30 near copies and of two: the first gives its members, the second its pair."""
    key = np.repeat([5, 6, 7], [30, 2, 2])
    same = np.zeros(34, np.int64)
    same[33] = -1
    got = mi.found({"node": mi.pa.array(np.arange(34)), "key": mi.pa.array(key), "s": mi.pa.array(same), "t": mi.pa.array(same)}, np.array([0, 30, 32]), 39, 32)
    assert got["a"].tolist() == [31, *range(30)] and got["b"].to_pylist() == [30] + [None] * 30 and got["key"].to_pylist() == [None] + [5] * 30
