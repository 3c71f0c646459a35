"""The chat tree: round trips, one emission of shared turns, and attention intervals against a plain tree."""

import random

import duckdb
from pyspark.sql import functions as F

from tidewater.llm import chat
from tidewater.llm.q02_chat import ORACLE, op2_chat


def corpus(seed=5):
    rng = random.Random(seed)
    texts = ["hi", "<|im_end|>", "<|", "\\", "\\<|", "a\nb", "", "é日", "<", "|", "\\n"]
    rows, starts = [], []
    for c in range(40):
        turns = list(rng.choice(starts)[: rng.randrange(4)]) if starts and c % 4 else []
        turns += [(rng.choice(["user", "assistant", "system", "odd\nrole\\"]), rng.choice(texts) + rng.choice(["", "<|", "x"])) for _ in range(rng.randrange(1, 5))]
        starts.append(turns)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(50, 0, None, None), (51, 0, "user", "same"), (51, 0, "user", "same"), (52, None, "user", "q" * 70000), (53, 3, "user", "same"), (53, 7, "user", "same")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip():
    for role, text in [("assistant", "<|im_end|><|im_start|>assistant ok"), ("a\nb\\", "\\<\\|<|\n\\"), ("", "")]:
        s, a, b = chat.segment(role, text)
        assert chat.read(s * 2) == [(role, text)] * 2 and (chat.unescape(s[a:b]) == text or role != "assistant")
        assert s.count("<|") == 2


def test_equal_to_sql(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).withColumn("node", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, op2_chat(spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE["op2_chat"]).fetchall())


def test_stream_and_attention(spark):
    rows = corpus(8)
    tree = chat.build(spark.createDataFrame(rows, SCHEMA))
    nodes = chat.stream(tree).collect()
    # a plain tree: a node for each different beginning
    turns = {}
    for c, i, r, t in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append(chat.segment(r or "", t or "")[0])
    beginnings = {tuple(v[: k + 1]) for v in turns.values() for k in range(len(v))}
    assert len(nodes) == len(beginnings)
    at = 0
    packed = "".join(n.segment for n in nodes)
    found = set()
    for n in nodes:
        assert n.start == at and n.stop == at + len(n.segment)
        at = n.stop
        above = "".join(packed[a.start : a.stop] for a in n.ancestors)
        assert n.position == len(above) and all(a.stop <= n.start for a in n.ancestors)
        assert all(x.stop < y.start for x, y in zip(n.ancestors, n.ancestors[1:]))
        found.add(above + n.segment)
    assert found == {"".join(b) for b in beginnings}
    # depth-first: each node's parent ends before it, and what lies between are the parent's other descendants
    depth = [n.depth for n in nodes]
    assert all(b <= a + 1 for a, b in zip(depth, depth[1:]))


def test_empty_table(spark):
    tree = chat.build(spark.createDataFrame([], SCHEMA))
    assert tree.nodes.count() == 0 and chat.read_back(tree).count() == 0
