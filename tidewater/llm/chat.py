"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

A turn is formatted as ``<|im_start|>role``, a line feed, its text,
``<|im_end|>`` and a line feed.  Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\\|`` (a line feed in a role gets a backslash before it),
so no text holds a control string and the way back is unique.

Conversations that begin with the same formatted turns share these as nodes of
a tree; a node's id is the digest of its parent's id and its own turn.  The
nodes are emitted depth-first into one packed stream, children after their
parent, each once.  With every node come

* ``start`` and ``stop``: where it stands in the stream,
* ``position``: the position id of its first unit, which counts from the
  conversation's begin and not from the stream's,
* ``ancestors``: the intervals of the stream before it that it may attend to,
  adjacent ones merged (inside itself attention is causal),
* ``mask_from`` and ``mask_to``: the part of it that is trained on, which is an
  assistant's text.

Units are code points of the formatted text.

The depth-first order is the order of the conversations' paths.  They are
sorted by range partitions; a conversation emits what the one before it in that
order did not, and offsets are sums within a partition plus one number for each
partition.  Equal conversations are one path.  A first turn that is shared by
most conversations is one node with pre-aggregated sizes; rows that look it up,
and conversations that many others equal, are sent to by broadcast.

Null texts and roles are empty; rows of one conversation are ordered by turn,
then role, then text, and repeated ones are kept.  Rows with a null
conversation id are one conversation.  A conversation, with its very long texts,
is one row.  An empty table gives an empty stream; other columns than the four
named ones are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as common

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"

_STEPS = "node binary, depth int, size int, position long, segment string, mask_from int, mask_to int"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and from where to where it is trained on."""
    head = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body) if role == TRAINED_ROLE else len(head)


def read(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def steps(turns: list[dict]) -> list[dict]:
    """The nodes on a conversation's path."""
    out, parent, position = [], b"", 0
    for depth, turn in enumerate(turns):
        text, a, b = segment(turn["role"], turn["text"])
        parent = hashlib.blake2b(parent + text.encode(), digest_size=16).digest()
        out.append({"node": parent, "depth": depth, "size": len(text), "position": position, "segment": text, "mask_from": a, "mask_to": b})
        position += len(text)
    return out


class Tree(NamedTuple):
    """``nodes``: one row for each node of the packed stream; ``paths``: a row (rank, depth, node) for each node on each different path; ``members``: the rank of each conversation's path."""

    nodes: DataFrame
    paths: DataFrame
    members: DataFrame


def _intervals(batch: pa.RecordBatch) -> dict:
    """Of the nodes that a path emits, the merged intervals of what stands above them."""
    out: dict[str, list] = {"node": [], "start": [], "stop": [], "ancestors": []}
    for rank, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        above: list[tuple[int, int]] = []
        for s in spans:
            if s["first_rank"] == rank:
                for name, value in (("node", s["node"]), ("start", s["start"]), ("stop", s["stop"]), ("ancestors", [{"start": a, "stop": b} for a, b in above])):
                    out[name].append(value)
            if above and above[-1][1] == s["start"]:
                above[-1] = (above[-1][0], s["stop"])
            else:
                above.append((s["start"], s["stop"]))
    return out


def build(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    empty = F.lit("")
    named = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text")).alias("row"))
    whole = named.groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    kind = whole.schema["conv"].dataType.simpleString()
    walked = common.durable(
        common.map_arrow(whole, lambda b: {"conv": b.column(0), "steps": [steps(t) for t in b.column(1).to_pylist()]}, f"conv {kind}, steps array<struct<{_STEPS.replace(' ', ':').replace(',:', ',')}>>")
    )
    leaf = F.element_at("steps", -1).node
    leaves = walked.groupBy(leaf.alias("leaf")).agg(F.any_value("steps").alias("steps"), F.count("*").alias("n"))
    ranked = common.durable(leaves.select("leaf", F.col("steps.node").alias("path"), "n").orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    members = common.join_counted(walked.select("conv", leaf.alias("leaf")), ranked.select("leaf", "rank", "n"), ["leaf"]).select("conv", "rank")
    paths = common.durable(ranked.select("rank", F.posexplode("path").alias("depth", "node")))
    firsts = paths.groupBy("node").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"))
    # a node's turn, from any conversation that has it
    texts = leaves.select(F.explode("steps").alias("s")).groupBy("s.node").agg(F.any_value("s").alias("s"))
    seen = common.durable(firsts.join(texts, "node").select("node", "first_rank", "n", *[f"s.{c}" for c in ("depth", "size", "position", "segment", "mask_from", "mask_to")]))
    # offsets: what earlier paths emit, summed within range partitions and then over them
    part = F.shiftrightunsigned("first_rank", 33)
    emitted = seen.groupBy("first_rank").agg(F.sum("size").alias("own"), F.min("position").alias("from")).withColumn("part", part)
    parts = emitted.groupBy("part").agg(F.sum("own").alias("whole"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the sort
    parts = parts.select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("first_rank").rowsBetween(Window.unboundedPreceding, -1)
    bases = emitted.withColumn("inside", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(F.broadcast(parts), "part").select("first_rank", (F.col("base") + F.col("inside") - F.col("from")).alias("shift"))
    placed = common.durable(seen.join(bases, "first_rank").select("node", "first_rank", "n", (F.col("shift") + F.col("position")).alias("start"), (F.col("shift") + F.col("position") + F.col("size")).alias("stop")))
    spans = common.join_counted(paths, placed, ["node"]).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "first_rank", "start", "stop"))).alias("spans"))
    above = common.map_arrow(spans, _intervals, "node binary, start long, stop long, ancestors array<struct<start:bigint,stop:bigint>>")
    nodes = common.durable(seen.drop("first_rank").join(above, "node"))
    return Tree(nodes, paths, members)


def stream(tree: Tree) -> DataFrame:
    """The packed stream: nodes in depth-first order."""
    return tree.nodes.drop("n").orderBy("start")


def _digests(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
    for rank, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        formatted = "".join(p["segment"] for p in pieces)
        turns = read(formatted)
        loss = "".join(unescape(p["segment"][p["mask_from"] : p["mask_to"]]) for p in pieces)
        out["rank"].append(rank)
        out["n_turns"].append(len(turns))
        out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        out["loss_chars"].append(len(loss))
        out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
        out["formatted_chars"].append(len(formatted))
    return out


def read_back(tree: Tree) -> DataFrame:
    """What the stream says of each conversation: its turns, the text under the loss mask and its size."""
    pieces = common.join_counted(tree.paths, tree.nodes.select("node", "n", "segment", "mask_from", "mask_to"), ["node"])
    whole = pieces.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "segment", "mask_from", "mask_to"))).alias("pieces"))
    found = common.map_arrow(whole, _digests, "rank long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    members = common.durable(tree.members)
    counted = common.durable(found.join(members.groupBy("rank").agg(F.count("*").alias("n")), "rank"))
    return common.join_counted(members, counted, ["rank"]).drop("rank", "n")
