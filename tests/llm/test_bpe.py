"""BPE by tree reduction against the public library's encoder, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest

from tidewater.llm import bpe
from tidewater.llm.q08_bpe import vocabulary

P = pytest.importorskip("public_tokenizers")
ALPHABET = [" ", " ", "\n", "'", "'s", "'re", "'ll", "a", "e", "l", "r", "v", "s", "t", "é", "ß", "日", "1", "²", "!", " ", "\t", "\x1c", "\x00", "the", "ing", "'d", "́", "🙂", "q" * 300, "z" * 70]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [2, 5, bpe.LEAF_CHARS])
def test_ids_equal_the_library(library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    own, rng = bpe.codec(vocabulary()), random.Random(leaf)
    for _ in range(700):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(np.array(ids, dtype=np.int64)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000 + "x", "!" * 700 + "a" * 900, "é" * 2000])
def test_long_pieces(library, text):
    assert bpe.codec(vocabulary()).encode(text) == library.encode_ordinary(text)


def test_memory_may_be_emptied_at_any_time(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Codec(vocabulary())
    for text in ["one two three four five", "six seven eight nine", "one two", "ten eleven twelve thirteen"] * 2:
        assert own.encode(text) == library.encode_ordinary(text)


def test_table(spark, library):
    texts = ["Plain text, twice.", "Plain text, twice.", None, "", "日本 " * 9000, "x" * 40000, "<|endoftext|> is text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as id")
    found = bpe.encode(docs, vocabulary())
    rows = {r.id: r for r in bpe.decode(found, vocabulary()).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert bytes(rows[i].decoded) == (text or "").encode()
    assert bpe.encode(docs.limit(0), vocabulary()).count() == 0
