"""The filter of suspects, the sample past long texts, and a decoded column that is taken."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import _common as common
from tidewater.llm import bpe, labelled


@pytest.mark.parametrize("words", [4, 1 << 20])
def test_suspects(spark, monkeypatch, words):
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    rows = spark.range(3000).select((F.col("id") * 7 - 9000).alias("id"), F.lit("x").alias("_h"), F.lit("y").alias("_own"))
    held = [random.Random(1).randrange(-9000, 12000) for _ in range(60)]
    hashes = spark.createDataFrame([(i,) for i in held], "id long").select(F.xxhash64("id").alias("h"))
    may, not_ = common.suspects(rows, F.xxhash64("id"), hashes)
    assert may.columns == not_.columns == rows.columns
    a, b = [r.id for r in may.collect()], [r.id for r in not_.collect()]
    assert sorted(a + b) == [i * 7 - 9000 for i in range(3000)]
    assert {i for i in held if (i + 9000) % 7 == 0} <= set(a)
    assert words == 4 or len(a) < 100
    empty, whole = common.suspects(rows, F.xxhash64("id"), hashes.limit(0))
    assert empty.count() == 0 and whole.count() == 3000


def test_a_text_that_does_not_fit_leaves_the_others_in(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, f"text {i}") for i in range(40)]
    whole = labelled.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 3, 1, chars=1000)
    assert len(whole[0]) > 20
    for k in (0, 3, 17, 39):
        long = [(i, "x" * 2000 if i == k else t) for i, t in rows]
        got = labelled.sample(spark.createDataFrame(long, "doc_id long, text string"), labels, "toxic", 3, 1, chars=1000)
        assert got[0] == [t for t in whole[0] if t != f"text {k}"]


def test_decode_keeps_a_column_of_that_name(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), path).withColumn("decoded", F.lit("own"))
    got = bpe.decode(tokens, path)
    assert got.columns == [*tokens.columns, "_decoded"]
    assert {(r.decoded, bytes(r._decoded)) for r in got.collect()} == {("own", b"a b"), ("own", b"")}
