"""Packing against the public tokenizer library and a plain version of the histogram's places."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import packing
from tidewater.llm.q12_packing import op12_packing, vocabulary

pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def held(pieces, want, capacity=1024, padding=packing.PADDING):
    """Every id in one piece, sequences without gaps, little padding; ``want``: document -> ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], dtype="<u4")
            assert r.crc == zlib.crc32(part.tobytes())
            assert r.ids is None or r.ids == part.tolist()
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    pads = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        pads += 0 if at & (at - 1) == 0 else capacity - at
    assert pads <= padding * sum(map(len, want.values()))
    return pads


def test_query_equals_the_library(spark, library):
    got = op12_packing(spark, SMALL).withColumnRenamed("ids_crc32", "crc").withColumn("ids", F.lit(None))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held(got.collect(), {r.doc_id: ids_of(library, r.text) for r in docs})


def test_odd_rows(spark, library):
    texts = ["", None, "a", "word " * 5000, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "é\n\n  日本 " * 900, "same " * 700, "same " * 700, "z" * 9000]
    rows = [(i, t, "own", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, rank int").repartition(3)
    pieces = packing.pack(docs, vocabulary())
    assert pieces.columns == ["doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "ids"]
    held(pieces.collect(), {i: ids_of(library, t) for i, t in enumerate(texts)})
    whole = packing.sequences(pieces).collect()
    for r in whole:
        assert len(r.ids) == 1024 or packing.power_of_two(len(r.ids))
        assert r.ids[len(r.ids) - r.padding :] == [0] * r.padding
    assert sum(len(r.ids) - r.padding for r in whole) == sum(len(ids_of(library, t)) for t in texts)
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_repeated_rows_and_null_ids_are_documents(spark, library):
    rows = [(None, "one two"), (None, "one two"), (4, "one two"), (4, "one two"), (4, "other")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()
    tokens = sum(len(ids_of(library, t)) for _, t in rows)
    assert sum(r.length for r in got) == tokens and {r.doc_id for r in got} == {None, 4}
    assert len({(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}) == tokens


def test_one_length_for_a_third_of_all(spark, library):
    docs = spark.createDataFrame([(i, "tide " * (600 if i % 3 == 0 else i % 50)) for i in range(300)], "doc_id long, text string").repartition(7)
    want = {r.doc_id: ids_of(library, r.text) for r in docs.collect()}
    held(packing.pack(docs, vocabulary()).collect(), want)
    held(packing.pack(docs, vocabulary(), capacity=64, padding=0.0).collect(), want, 64, 0.0)


@pytest.mark.parametrize("seed", range(30))
def test_places_fill_packs_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 1024])
    lengths = rng.sample(range(1, capacity + 1), rng.randrange(1, min(capacity, 40)))
    histogram = {n: rng.choice([1, 2, 7, 50]) for n in lengths}
    padding = rng.choice([0.0, 0.01, 1.0])
    packs, cut = packing.packed(histogram, capacity, padding)
    tokens = sum(n * k for n, k in histogram.items())
    assert packs.padding() <= padding * tokens
    filled = defaultdict(list)
    for length, low, high, shift, times, sequence, place, begin, size in packing.places(histogram, packs, cut):
        for rank in range(low, high):
            filled[sequence + (rank + shift) // times].append((place + (rank + shift) % times * size, size, length, rank, begin))
    pads = 0
    for rows in filled.values():
        at = 0
        for place, size, *_ in sorted(rows):
            assert place == at
            at += size
        pads += 0 if packing.power_of_two(at) else capacity - at
        assert at <= capacity
    assert pads == packs.padding() and sorted(filled) == list(range(len(filled)))
    spans = sorted((length, rank, begin, size) for rows in filled.values() for _, size, length, rank, begin in rows)
    whole = defaultdict(int)
    for length, rank, begin, size in spans:
        assert whole[length, rank] == begin
        whole[length, rank] += size
    assert all(whole[n, k] == n for n in histogram for k in range(histogram[n])) and len(whole) == sum(histogram.values())


def test_shortest_pack_first():
    """Without cuts each piece, longest first, goes to the pack that holds least, as if taken one at a time."""
    rng = random.Random(5)
    for _ in range(50):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))}
        plain = []
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            room = max((64 - used for used in plain), default=0)
            if room >= n:
                plain[plain.index(64 - room)] += n
            else:
                plain.append(n)
        packs, cut = packing.packed(histogram, 64, 100.0)
        assert not cut
        assert sorted(plain) == sorted(sum(n * t for n, t, _ in runs) for runs, k in packs.patterns() for _ in range(k))


def test_ids_equal_the_library_on_odd_texts(library):
    rng = random.Random(3)
    parts = [" ", "\n", "'s", "'ll", "a", "the", "é", "日", "1", "!", "\t", "<|endoftext|>", "<|endo", "text|>", "🙂", "q" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(500)]
    got = [x.tolist() for x in packing.ids_of(pa.array(texts), vocabulary())]
    assert got == [ids_of(library, t) for t in texts]
