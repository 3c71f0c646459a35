"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint is the bitwise majority of the 64-bit hashes of its word
shingles.  Two fingerprints are linked if at most ``radius`` bits differ.  The
64 bits are cut into ``segments`` parts, by default as many as are the least work
for the number of fingerprints.  By the pigeonhole rule linked
fingerprints lie, in one of the segments, within a small Hamming ball of each
other; so each fingerprint looks up the values of the balls round its own
segments in one table per segment, and what it finds is verified on all bits.

Equal fingerprints are first folded into one row.  A table entry (segment,
value) that holds more than ``hot_entry`` different fingerprints would answer
each lookup with all of them.  For these entries, links are found without
pairs: two fingerprints within ``radius`` of each other have a common point
within ``radius / 2`` of both, so each lists the points of its own half-radius
ball and each point links those who listed it to the smallest of them.  Points
shared by two fingerprints prove a distance within ``radius``, so no link is
lost or made up.

Null and empty texts have fingerprint zero and are linked like any other.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as common
from .components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
HOT_ENTRY = 512


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 16384 + 1):  # 1 MB of bits at a time
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)`` with the fingerprint's 64 bits as a signed long."""

    def rows(batch: pa.RecordBatch) -> dict:
        prints = [fingerprint(text, shingle_words) for text in common.each_text(batch.column(1))]
        return {"id": batch.column(0), "fp": np.array(prints, dtype=np.uint64).view(np.int64)}

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")), rows, "id long, fp long")


def _segments(segments: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    width, more = divmod(bits, segments)
    out, shift = [], 0
    for i in range(segments):
        w = width + (i < more)
        out.append((shift, w))
        shift += w
    return out


def _plan(segments: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(number, shift, width, radius) of each segment: linked fingerprints are within this radius in one of them; some need no look."""
    whole, more = divmod(radius, segments)
    parts = [(k, shift, width, whole if k <= more else whole - 1) for k, (shift, width) in enumerate(_segments(segments))]
    return [p for p in parts if p[3] >= 0]


def best_segments(n: int, radius: int = RADIUS) -> int:
    """The number of segments with the least work for ``n`` fingerprints: points of the balls, and entries that random fingerprints have there.

    Three up to some 30 million fingerprints, two (of 32 bits) beyond; the links are the same.
    """

    def work(segments: int) -> float:
        return sum(sum(comb(width, d) for d in range(r + 1)) * (1 + n / 2**width) for _, _, width, r in _plan(segments, radius))

    return min(range(1, 9), key=work)


def _ball(width: int, radius: int) -> list[int]:
    """XOR masks of the Hamming ball of this radius over ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _longs(values: list[int]) -> Column:
    """An array literal; as text, so that thousands of values stay one expression."""
    signed = ",".join(str(v - (1 << 64) if v >> 63 else v) for v in values)
    return F.transform(F.split(F.lit(signed), ","), lambda x: x.cast("long"))


def links(prints: DataFrame, radius: int = RADIUS, segments: int = 3, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """Links between different fingerprints: ``(a, b)``, a > b.

    ``prints`` has distinct values in ``fp``.  Within hot entries a chain of
    links through the smallest neighbour stands for all links of a ball's
    point; connectivity is that of all links.
    """
    parts = _plan(segments, radius)

    def value(shift: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    entries = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), value(s, w).alias("val")) for k, s, w, _ in parts])).alias("e")).select("fp", "e.seg", "e.val")
    lookups = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), value(s, w).alias("own"), _longs(_ball(w, r)).alias("masks")) for k, s, w, r in parts])).alias("e")).select(
        "fp", "e.seg", "e.own", F.explode("e.masks").alias("mask")
    ).select("fp", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val"))

    sizes = entries.groupBy("seg", "val").agg(F.count("*").alias("n"))
    hot = common.durable(sizes.filter(F.col("n") > hot_entry).select("seg", "val"))
    # every join is by sorting: adaptive execution would collect and build tables of many points on the driver, as their shuffled bytes are few
    cold_entries = entries.join(hot.hint("merge"), ["seg", "val"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    # balls are symmetric, so each link is found from both of its ends: the larger one's lookup is enough
    cold = lookups.join(cold_entries.withColumnRenamed("fp", "other").hint("merge"), ["seg", "val"]).filter((F.col("fp") > F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if hot.isEmpty():
        return cold
    inside = common.durable(lookups.join(hot.hint("merge"), ["seg", "val"], "left_semi").select("fp").distinct())
    points = inside.select("fp", F.explode(_longs(_ball(64, radius // 2))).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp")
    least = points.groupBy("point").agg(F.min("fp").alias("b"))
    stars = points.join(least.hint("merge"), "point").filter(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return cold.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int | None = None, shingle_words: int = SHINGLE_WORDS, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """``(id, fp, component)``: the smallest id reachable over links, itself included.

    One row per row of ``docs``; rows with equal ids count as one node each with
    their own text, and share whatever component is smaller.  Other columns of
    ``docs`` are not read, whatever their names.  Fingerprints of many copies
    and components of many fingerprints are joined where their rows are.
    """
    prints = common.durable(fingerprints(docs, id_col, text_col, shingle_words))
    classes = common.durable(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    joined = components(links(classes.select("fp"), radius, segments or best_segments(classes.count(), radius), hot_entry))
    labelled = common.durable(classes.join(joined.hint("merge"), classes.fp == joined.node, "left").select("fp", "least", classes.n.alias("copies"), F.coalesce("root", "fp").alias("root")))
    # least id of each component, then of each fingerprint
    roots = common.durable(labelled.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")))
    by_print = common.durable(common.join_counted(labelled, roots, ["root"]).select("fp", "component", F.col("copies").alias("n")))
    return common.join_counted(prints, by_print, ["fp"]).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, and of several texts of this id the one with the smallest hash.

    Of rows with equal ids and texts one stays.  Rows without an id can't stand for a group or be told apart; they all stay.
    """
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    numbered = rows.withColumn("number", F.xxhash64("id", "key"))  # rows of one id with different texts have numbers of their own
    found = common.durable(near_duplicates(numbered, "number", "text", **options).select(F.col("id").alias("number"), "component").distinct())
    placed = common.durable(numbered.select("id", "key", "number").join(found, "number"))
    least = placed.groupBy("component").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("n"))
    judged = common.join_counted(placed, common.durable(least), ["component"])
    return common.keep_first(docs, judged.select("id", "key", (F.struct("id", "key") == F.col("least")).alias("stays")), id_col, text_col)
