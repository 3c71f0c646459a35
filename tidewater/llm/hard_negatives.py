"""Hard negatives by blocked dense products.

Vectors become whole numbers (``floor(scale * x)``), so scores are exact.  Anchors
are dealt into blocks of bounded bytes; a block is broadcast and multiplied with
blocks of candidates in float64, where whole numbers below 2**53 are exact, in
the tasks that read the candidates.  Two passes over the candidates are made for
each anchor block: the first keeps each anchor's best rows of its own label,
the second, for each of these, the best rows of other labels whose scores lie in
the window that the positive's score opens.  A task keeps the best k for each anchor (or
positive) and merges them block by block; tasks' bests are merged by a window
over at most k rows of each task.  So what moves is bounded by anchors, tasks
and k, and no candidate row is shuffled.

Scores that may reach 2**53 are computed in Python's whole numbers; those beyond
2**63 - 1 count as that number, and below its negative as its negative.

Rows without an id, a label or a vector, or with a component that is null, NaN
or infinite take no part.  Missing components count as zero, so vectors may
differ in length and be empty.  Each row is a candidate of its own; a row of the anchor's id is never its
positive.  Equal anchor rows are one anchor; anchors of one id that differ each
have their rows.  An empty table gives no rows.  Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as common

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is between these percents of the positive's.
LOW, HIGH = 80, 100
#: Bytes of an anchor block as float64, at most (a single longer vector is a block).
ANCHOR_BYTES = 16_000_000
#: Products that are held at once.
BLOCK_CELLS = 1 << 21
_EXACT = 1 << 53
_MOST = (1 << 63) - 1


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``(id, label, v)`` of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    infinite = F.lit(float("inf"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Lists of doubles as rows of whole numbers in float64; shorter ones end with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d == 0 or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(whole(a), whole(b).T), -_MOST, _MOST).astype(np.int64)


class Best:
    """The best ``k`` of each group by score, largest first, and id, smallest first."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.group = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.bound = np.full(groups, -_MOST, dtype=np.int64)  #: a score that a group's new rows have to reach

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.bound[group[full]] = score[full]


def _passed(candidates: DataFrame, anchors: np.ndarray, groups: int, k: int, scale: float, hits) -> DataFrame:
    """``(group, score, id)``: the best ``k`` of each group in each task; ``hits`` gives the groups, scores and ids of a block."""
    common.bounded_batches(candidates.sparkSession)
    sent = candidates.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(groups, k)
        for batch in batches:
            width = max(1, BLOCK_CELLS // max(1, len(sent.value)))
            for at in range(0, batch.num_rows, width):
                ids, labels, v = (batch.column(i).slice(at, width) for i in range(3))
                ids, labels = ids.to_numpy(), labels.to_numpy()
                scores = products(sent.value, matrix(v, scale))
                hits(best, scores, ids, labels)
        if len(best.group):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (best.group, best.score, best.id)], names=["group", "score", "id"])

    found = candidates.mapInArrow(run, "group long, score long, id long")
    order = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(candidates: DataFrame, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int, scale: float) -> DataFrame:
    def hits(best: Best, scores: np.ndarray, own: np.ndarray, own_labels: np.ndarray) -> None:
        reach = scores >= best.bound[:, None]
        reach &= labels[:, None] == own_labels
        reach &= ids[:, None] != own
        a, c = np.nonzero(reach)
        best.add(a, scores[a, c], own[c])

    return _passed(candidates, anchors, len(ids), k, scale, hits)


def _negatives(candidates: DataFrame, labels: np.ndarray, anchors: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], window: tuple[int, int], k: int, scale: float) -> DataFrame:
    """``pairs``: each positive's anchor (its row in ``anchors``) and score; these are the groups."""
    anchor, score = pairs
    low, high = window
    exact = [int(s) for s in score]
    least = np.array([min(max(-(-low * s // 100), -_MOST), _MOST) for s in exact], dtype=np.int64)  # the smallest score in the window
    most = np.array([min(max(high * s // 100, -_MOST), _MOST) for s in exact], dtype=np.int64)

    def hits(best: Best, scores: np.ndarray, own: np.ndarray, own_labels: np.ndarray) -> None:
        other = labels[:, None] != own_labels
        size = max(1, BLOCK_CELLS // len(own))
        found = []
        for first in range(0, len(anchor), size):
            part = slice(first, first + size)
            rows = scores[anchor[part]]
            reach = rows >= np.maximum(least[part], best.bound[part])[:, None]
            reach &= rows <= most[part][:, None]
            reach &= other[anchor[part]]
            p, c = np.nonzero(reach)
            found.append((p + first, rows[p, c], own[c]))
        best.add(*(np.concatenate(x) for x in zip(*found)))

    return _passed(candidates, anchors, len(anchor), k, scale, hits)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH), scale: float = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that ``anchor`` holds for.

    ``label`` may be an expression over ``rows``; ``window`` is in percent of the positive's score, both ends included.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label) if isinstance(label, str) else label
    candidates = usable(rows, id_col, label, vector_col)
    anchors = common.written(usable(rows.filter(anchor), id_col, label, vector_col).distinct())
    held = anchors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0)).alias("bytes")).first()
    blocks = -(-held.bytes // ANCHOR_BYTES)
    found = []
    for block in range(blocks):
        # rows are dealt by a hash of all they have: no two are equal
        own = anchors if blocks == 1 else anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == block)
        table = own.orderBy("id", "label").toArrow().combine_chunks()
        if table.num_rows:
            one = _block(candidates, table, positives, negatives, window, scale)
            found.append(common.written(one) if blocks > 1 else one)
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def _block(candidates: DataFrame, table: pa.Table, positives: int, negatives: int, window: tuple[int, int], scale: float) -> DataFrame:
    spark = candidates.sparkSession
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    vectors = matrix(table.column("v").combine_chunks(), scale)
    best = _positives(candidates, ids, labels, vectors, positives, scale).toArrow()
    pairs = spark.createDataFrame([], "group long, anchor_id long, positive_id long, positive_score long")
    schema = pairs.schema
    if best.num_rows:
        anchor, score, own = (best.column(c).to_numpy() for c in ("group", "score", "id"))
        pairs = spark.createDataFrame(pa.table({"group": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": own, "positive_score": score}), schema)
        found = _negatives(candidates, labels, vectors, (anchor, score), window, negatives, scale)
    else:
        found = spark.createDataFrame([], "group long, score long, id long, rank int")
    # the pairs number as many as the block's anchors times ``positives`` at most
    return found.join(F.broadcast(pairs), "group").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
