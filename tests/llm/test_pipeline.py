"""The pipeline against a plain version of its stages on a small corpus."""

import base64
import hashlib
import random

import pytest

from tidewater.llm import labelled, toxicity
from tidewater.llm.q08_bpe import vocabulary

from . import test_decontaminate, test_line_dedup, test_near_copies, test_toxicity


def corpus():
    rng = random.Random(11)
    rows, labels = test_toxicity.corpus(150, 5)
    passage = " ".join(f"shared{i}" for i in range(60))
    item = " ".join(f"item{i}" for i in range(14))
    rows = [(i, t if i % 7 else f"{t}\n{passage}\nend {i}") for i, t in rows]
    rows += [(200 + i, rows[i][1].replace("rine", "rina")) for i in range(1, 150, 11)] + [(600 + i, rows[i][1]) for i in range(0, 150, 13)]
    rows += [(400 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(40)) + f". {item}! fin") for i in range(6)] + [(500, item), (501, None), (502, "")]
    return rows, labels, [(1, item), (2, "not here")]


def test_equal_to_plain_stages(spark, tmp_path):
    pipeline, tiktoken = pytest.importorskip("corpus_pipeline"), pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}

    texts, marks = labelled.sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", 3, 1)
    model = toxicity.Model.fit(texts, marks)
    left = [(i, t) for i, t in rows if model.score([(t or "").encode()])[0] < toxicity.THRESHOLD]
    assert len(left) < len(rows)
    gone = dict(test_line_dedup.slow([(i, t) for i, t in left], 50))
    cut = [(i, t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in left]
    cut = [(i, t) for i, t in cut if not gone[i] or t.split()]
    kept = {i for i, _, c in test_near_copies.slow_components(cut) if i == c}
    single = [(i, t) for i, t in cut if i in kept]
    assert len(kept) < len(cut) < len(left)
    hits = {i: (n, h) for i, n, h, _ in test_decontaminate.slow(single, items)}
    whole = [(i, t) for i, t in single if 2 * hits[i][1] <= hits[i][0]]
    assert 0 < len(whole) < len(single)
    with open(vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(got) == {i for i, _ in whole}
    for i, t in whole:
        if hits[i][1]:
            t = " ".join(p for p in t.split(items[0][1]))
        assert list(got[i].ids) == library.encode_ordinary(t or "") and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
