"""Merkle digests of snapshots and links of audit rows.

A leaf covers a range of keys and holds its number of rows and the sum of their digests, so rows
are combined where they are read and never collected.  Above it each node is the digest of at most
``FANOUT`` children.  Two snapshots are compared from the top: only children of nodes
that differ are looked at, and only the key ranges of leaves that differ are read again.

A row's digest is the SHA-256 of its key and columns as JSON, with nulls; repeated rows count.
Keys are whole numbers; rows without a key take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

WIDTH, FANOUT = 256, 16
#: Ranges that are passed to a scan as bounds; more are joined.
MOST_BOUNDS = 200
_LANES = 8


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


@dataclass
class Tree:
    """``levels[k]`` has (idx, digest): level 0 are the leaves, the last has one node, or none for an empty snapshot."""

    levels: list[DataFrame]
    width: int
    root: str | None
    rows: int


def tree(rows: DataFrame, key: str, columns: list[str], width: int = WIDTH, fanout: int = FANOUT) -> Tree:
    """The tree of ``rows``; its nodes are written, its root comes back."""
    lanes = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long") for i in range(_LANES)]
    whole = rows.filter(F.col(key).isNotNull()).select(F.floor(F.col(key) / F.lit(width)).cast("long").alias("idx"), row_digest([key, *columns]).alias("_d"))
    sums = whole.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"l{i}") for i, x in enumerate(lanes)])
    levels = [durable(sums.select("idx", "n", F.sha2(F.concat_ws(":", "idx", "n", *[f"l{i}" for i in range(_LANES)]), 256).alias("digest")))]
    n = levels[0].agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    low, high = n.low, n.high
    while n.k and low != high:
        # numbers on both sides of zero meet above the level where -1 and 0 are left
        last = (low, high) == (-1, 0)
        parent = F.lit(0).cast("long") if last else F.floor(F.col("idx") / fanout).cast("long")
        grouped = levels[-1].groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("idx").cast("string"), 21, " "), "digest"))).alias("children"))
        levels.append(durable(grouped.select(F.col("parent").alias("idx"), F.sha2(F.array_join("children", ","), 256).alias("digest"))))
        low, high = (0, 0) if last else (low // fanout, high // fanout)
    top = levels[-1].first()
    return Tree(levels, width, top.digest if top else None, n.n or 0)


def differing(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame:
    """``(idx)`` of the leaves in which two trees of one width differ, found from the top down."""
    if a.width != b.width:
        raise ValueError("trees of different widths can't be compared")
    none = a.levels[0].select("idx").limit(0)
    if a.root == b.root:
        return none
    if a.root is None or b.root is None:
        return (a if b.root is None else b).levels[0].select("idx")
    # a side with fewer levels is compared from its own top, as is whatever of the other lies outside of it
    height = min(len(a.levels), len(b.levels))
    found = None
    for level in range(height - 1, -1, -1):
        x, y = (t.levels[level].select("idx", F.col("digest").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if found is not None:
            parent = F.floor(F.col("idx") / fanout).cast("long").alias("_parent")
            crossing = [t.levels[level + 1] is t.levels[-1] and _crosses(t, level) for t in (a, b)]
            if not any(crossing):
                wanted = found.withColumnRenamed("idx", "_parent")
                x, y = (t.select("*", parent).join(wanted, "_parent", "left_semi").drop("_parent") for t in (x, y))
        found = durable(x.join(y, "idx", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("idx"))
    return found


def _crosses(t: Tree, level: int) -> bool:
    """Whether the nodes of a level are -1 and 0, whose parent is no quotient."""
    return t.levels[level].filter("idx < 0").limit(1).count() > 0 and len(t.levels) == level + 2


def in_ranges(rows: DataFrame, key: str, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """``rows`` whose key lies in one of the ``ranges`` (idx): up to ``MOST_BOUNDS`` runs of them are bounds of the scan."""
    some = [r.idx for r in ranges.orderBy("idx").limit(MOST_BOUNDS * 4 + 1).collect()]
    runs: list[list[int]] = []
    for i in some:
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    if len(some) <= MOST_BOUNDS * 4 and len(runs) <= MOST_BOUNDS:
        condition = F.lit(False)
        for low, high in runs:
            condition = condition | ((F.col(key) >= low * width) & (F.col(key) < high * width))
        return rows.filter(condition)
    return rows.join(ranges, F.floor(F.col(key) / F.lit(width)).cast("long") == F.col("idx"), "left_semi")


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """``(key, change)``: rows added, removed or changed, of the key ranges alone whose digests differ.  Keys are unique in each snapshot."""
    ranges = durable(differing(tree(before, key, columns, width), tree(after, key, columns, width)))
    a, b = (in_ranges(x.select(key, *columns), key, ranges, width).select(key, row_digest([key, *columns]).alias(n)) for x, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def linked(rows: DataFrame, seq: str, columns: list[str]) -> DataFrame:
    """Audit ``rows`` with ``digest`` of their own content and ``link``, the digest of that and of the row before in ``seq`` (null before the first).

    ``seq`` goes up by one; a row meets its predecessor by equality, so no order runs through one task.
    """
    own = rows.withColumn("digest", row_digest([seq, *columns]))
    before = own.select((F.col(seq) + 1).alias("_next"), F.col("digest").alias("_before"))
    joined = own.join(before, own[seq] == F.col("_next"), "left")
    return joined.withColumn("link", F.when(F.col("_before").isNotNull(), F.sha2(F.concat("digest", "_before"), 256))).drop("_next", "_before")


def broken(rows: DataFrame, seq: str, columns: list[str], first: int, last: int) -> DataFrame:
    """``(seq, fault)`` of linked audit rows that should go from ``first`` to ``last``: ``tampered`` content, a ``deleted`` row before (or at the end), a ``relinked`` one."""
    own = rows.withColumn("_now", row_digest([seq, *columns]))
    before = own.select((F.col(seq) + 1).alias("_next"), F.col("digest").alias("_before"))
    joined = own.join(before, own[seq] == F.col("_next"), "left")
    gap = F.col("_before").isNull() & (F.col(seq) > first)
    wrong = F.col("_before").isNotNull() & ~F.coalesce(F.col("link") == F.sha2(F.concat("digest", "_before"), 256), F.lit(False))
    faults = F.array_compact(F.array(F.when(F.col("_now") != F.col("digest"), F.lit("tampered")), F.when(gap, F.lit("deleted")), F.when(wrong, F.lit("relinked"))))
    found = joined.select(F.col(seq).alias("seq"), F.explode(faults).alias("fault"))
    ends = rows.agg(F.max(seq).alias("m")).filter(F.coalesce("m", F.lit(first - 1)) < last).select(F.lit(last + 1).cast("long").alias("seq"), F.lit("deleted").alias("fault"))
    return found.select(F.col("seq").cast("long").alias("seq"), "fault").unionByName(ends)
