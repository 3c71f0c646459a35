"""Links between long SimHash fingerprints by multi-index hashing.

The tables are keyed by segments of the fingerprint: each text has one entry in each table
and looks up its own value there.  Fingerprints that differ in
many bits, as near copies at a similarity of 0.8 do, can't be found by the pigeonhole rule
alone: balls as wide as it asks for hold an eighth of all texts.  So the look-up has radius zero, and there
are as many segments as let a pair right at the similarity be equal in one of them with a chance of
``FOUND``; what is found is verified on all bits.

A segment has ``LEAST_WIDTH`` bits, or as many as leave ``LOAD`` texts to an entry by chance.
Their number grows with the logarithm of the corpus and the segments with them: 62 up to
500,000 different texts, 143 for 16 million.

1. Each entry is a run of rows with the table's key, the text's number and a sketch of 128 bits.
2. In an entry of up to ``hot_entry`` texts sketches are compared.  Pairs that may be near enough are listed and
   verified by complete distances, unless they are as many as the texts in them.
3. Else these texts, and all those of a larger entry, are a group of near copies.  It is walked by complete distances, so
   its pairs aren't listed (``near_copies.walked``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common

LEAST_WIDTH = 16
LOAD = 8
FOUND = 0.99
HOT_ENTRY = 32
#: Texts whose entries a worker makes at once.
AT_ONCE = 512
#: Bits of a sketch.
SKETCH = 128


def segments(n: int, differ: float, bits: int) -> np.ndarray:
    """The bits (segment, place) of each segment, for ``n`` texts and pairs that differ in the share ``differ`` of bits; disjoint as far as the bits go, then in a new order of them."""
    width = min(40, max(LEAST_WIDTH, ceil(log2(max(1, n) / LOAD))), bits)
    count = ceil(log(1 - FOUND) / log(1 - (1 - differ) ** width))
    each = bits // width
    rng = np.random.default_rng(1)
    orders = [np.arange(bits) if k == 0 else rng.permutation(bits) for k in range(ceil(count / each))]
    return np.concatenate([o[: each * width].reshape(each, width) for o in orders])[:count]


def values(prints: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Keys (row, segment) of fingerprints (row, byte): the segment's number and its bits."""
    out = np.empty((len(prints), len(chosen)), dtype=np.int64)
    for at in range(0, len(prints), AT_ONCE):
        bits = np.unpackbits(prints[at : at + AT_ONCE], axis=1)
        for k, places in enumerate(chosen):
            own = np.full(len(bits), k + 1, dtype=np.int64)
            for p in places.tolist():
                own = own << 1 | bits[:, p]
            out[at : at + AT_ONCE, k] = own
    return out


def sketch_limit(most: int, bits: int) -> int:
    """Bits of a sketch that pairs with up to ``most`` of ``bits`` differ in, but for some 3 of 100,000."""
    q = most / bits
    return int(SKETCH * q + 4 * sqrt(SKETCH * q * (1 - q)))


def matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints (row, byte) of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def entries(nodes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``(key, node, s, t)``: a row for each text and segment, with both halves of the sketch; fingerprint zero has none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                prints = matrix(part.column(1))
                some = prints.any(axis=1)
                prints, node = np.ascontiguousarray(prints[some]), part.column(0).to_numpy()[some]
                sketch = np.ascontiguousarray(prints[:, : SKETCH // 8]).view(np.int64)
                columns = [values(prints, chosen).ravel(), *(np.repeat(c, len(chosen)) for c in (node, sketch[:, 0], sketch[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "s", "t"])

    common.bounded_batches(nodes.sparkSession)
    return nodes.select("node", "fp").mapInArrow(rows, "key long, node long, s long, t long")


def found(columns: dict, begins: np.ndarray, limit: int, hot_entry: int) -> dict:
    """Pairs (a, b) whose sketches are near, of small runs with fewer of them than rows, and members (a, key) of the other runs that have any."""
    node, key = (columns[c].to_numpy() for c in ("node", "key"))
    s, t = (columns[c].to_numpy().view(np.uint64) for c in ("s", "t"))
    sizes = np.diff(np.append(begins, len(node)))
    run = np.repeat(np.arange(len(sizes)), sizes)
    left = begins[run] + sizes[run] - np.arange(len(node)) - 1  # rows of the run after this one
    hot = sizes > hot_entry
    left[hot[run]] = 0
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step = np.flatnonzero(left > 0), 1
    while len(at):
        near = at[np.bitwise_count(s[at] ^ s[at + step]) + np.bitwise_count(t[at] ^ t[at + step]) <= limit]
        one.append(near)
        two.append(near + step)
        step += 1
        at = at[left[at] >= step]
    x, y = np.concatenate(one), np.concatenate(two)
    # a group's pairs grow with its square, its members don't
    partners = np.zeros(len(node), dtype=bool)
    partners[x] = partners[y] = True
    dense = hot | (np.bincount(run[x], minlength=len(sizes)) >= np.maximum(2, np.bincount(run[partners], minlength=len(sizes))))
    member = hot[run] | partners & dense[run]
    listed = ~dense[run[x]]
    x, y = node[x[listed]], node[y[listed]]
    pairs, members = len(x), int(member.sum())
    return {
        "a": np.concatenate([np.maximum(x, y), node[member]]),
        "b": pa.array(np.concatenate([np.minimum(x, y), np.zeros(members, np.int64)]), mask=np.arange(pairs + members) >= pairs),
        "key": pa.array(np.concatenate([np.zeros(pairs, np.int64), key[member]]), mask=np.arange(pairs + members) < pairs),
    }


def verified(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``pairs`` (a, b) whose fingerprints differ in up to ``most`` bits."""
    prints = nodes.select("node", "fp")
    both = pairs.join(prints.select(F.col("node").alias("a"), F.col("fp").alias("x")).hint("merge"), "a").join(prints.select(F.col("node").alias("b"), F.col("fp").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def rows(batch: pa.RecordBatch) -> dict:
        near = np.bitwise_count(matrix(batch.column(2)) ^ matrix(batch.column(3))).sum(axis=1, dtype=np.int64) <= most
        return {"a": batch.column(0).to_numpy()[near], "b": batch.column(1).to_numpy()[near]}

    return common.map_arrow(both, rows, "a long, b long")


def links(nodes: DataFrame, most: int, differ: float, bits: int, hot_entry: int = HOT_ENTRY, block: int | None = None) -> DataFrame:
    """``(a, b)`` of ``nodes`` (node, fp), a durable table, that connect what is equal in a segment and differs in up to ``most`` bits."""
    from .near_copies import BLOCK, _runs, blocked, walked

    limit = sketch_limit(most, bits)
    table = entries(nodes, segments(nodes.count(), differ, bits)).repartition("key").sortWithinPartitions("key")
    met = common.durable(_runs(["key"], lambda columns, begins: found(columns, begins, limit, hot_entry), "a long, b long, key long", table))
    cold = verified(met.filter("key IS NULL").select("a", "b").distinct(), nodes, most)
    members = met.filter("key IS NOT NULL").select("key", F.col("a").alias("node"))
    return cold.unionByName(walked(blocked(members, block or BLOCK), nodes, most)).distinct()
