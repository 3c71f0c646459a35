"""Removal of repeated runs of lines by winnowing.

A text's lines are its ``\\n``-split parts without outer white space; lines
without words are not part of the sequence.  A run of consecutive lines counts
if it has ``MIN_WORDS`` words or more.  Runs of lines are repeated if they are
equal to a run at an earlier place; places are ordered by document id, then by
line.  Every line of a repeated run is deleted, however far the run reaches.

1. Winnowing.  From each line on, and up to each line, the shortest stretch of
   lines with ``MIN_WORDS`` words is a window; in each the line with the
   smallest hash is selected.  A window depends on its own lines only, so a
   repeated run, wherever it is, selects the same fingerprints.
2. Positions of fingerprints that were selected more than once are joined.
3. Matches are extended both ways.  The windows round a joined position that
   begin or end at each line are compared as wholes with the earliest equal
   window, so a chain of windows follows a run in both directions to its ends,
   against all earlier places at once: any run of enough words is the union of
   its windows.  Line by line against one earlier place, a run that goes on in
   another one would be cut short, and against each of them all pairs of
   positions would be listed; the chain of windows does neither.
4. Lines in a window that has an earlier equal one, which it does not overlap,
   go.

Lines are compared by 128-bit BLAKE2 digests, windows by the digest of their
lines' digests, so nothing is deleted for a chance or made collision.  Null
texts stay null.  Rows that share an id count as one place, so of equal rows
with one id none loses anything to the other.  Columns of any name are kept; a
text of any length is one row's work.  A document that loses all its words may be
dropped (``dedupe_lines``); other columns are kept as they are.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common
from . import words

MIN_WORDS = 50
_SOLID = words.byte_table(lambda b: b != 32 and not 9 <= b <= 13, lower=False)


def _digests(data: memoryview, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit digests of data[start:stop], as two longs each."""
    found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values))


def lines_of(column: pa.Array) -> dict[str, pa.Array]:
    """Of each text its lines with words: their numbers, both halves of their digests, and counts of words."""
    data, offsets = common.raw_texts(column)
    whole = np.frombuffer(data, dtype=np.uint8)
    numbers, hashed, more, counts, sizes = [], [], [], [], []
    for i, j in common.chunks(offsets):
        raw = whole[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        if not len(raw):
            sizes.append(np.zeros(j - i, np.int64))
            continue
        begins = np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1]))
        begins = begins[begins < len(raw)]
        starts, ends = words.spans(_SOLID[raw], at)
        first = np.searchsorted(starts, begins)
        last = np.append(first[1:], len(starts))
        text = np.searchsorted(at, begins, side="right") - 1
        order = np.arange(len(begins)) - np.searchsorted(begins, at[:-1])[text]
        real = last > first
        digests = _digests(data[offsets[i] : offsets[j]], starts[first[real]], ends[last[real] - 1])
        hashed.append(digests[:, 0])
        more.append(digests[:, 1])
        numbers.append(order[real].astype(np.int32))
        counts.append((last - first)[real].astype(np.int32))
        sizes.append(np.bincount(text[real], minlength=j - i))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    ends = np.append(0, np.cumsum(join(sizes, np.int64))).astype(np.int64)
    return {"number": _list(join(numbers, np.int32), ends), "hash": _list(join(hashed, np.int64), ends), "more": _list(join(more, np.int64), ends), "words": _list(join(counts, np.int32), ends)}


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls, and its offsets."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends


def windows(counts: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window of the texts whose lines begin and end at ``ends``."""
    n = len(counts)
    total = np.append(0, np.cumsum(counts, dtype=np.int64))
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    line = np.arange(n)
    last = np.searchsorted(total, total[:-1] + min_words) - 1
    ahead = last < ends[1:][text]
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    behind = first >= ends[:-1][text]
    both = np.unique(np.concatenate([line[ahead], first[behind]]) * (n + 1) + np.concatenate([last[ahead], line[behind]]))
    return both // (n + 1), both % (n + 1)


def minima(hashed: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The line with the smallest hash in each window, the last of equal ones."""
    if not len(first):
        return np.zeros(0, np.int64)
    size = last - first + 1
    level = np.frexp(size)[1] - 1  # the largest power of two that is not longer
    best = np.arange(len(hashed))
    out = np.zeros(len(first), dtype=np.int64)
    lower = lambda a, b: np.where(hashed[b] <= hashed[a], b, a)
    for k in range(int(level.max()) + 1):
        own = level == k
        out[own] = lower(best[first[own]], best[last[own] + 1 - (1 << k)])
        if len(best) > 1 << k:
            best = lower(best[: -(1 << k)], best[1 << k :])
    return out


def _selected(batch: pa.RecordBatch, min_words: int) -> dict:
    """The fingerprints of texts: each selected line once."""
    hashed, ends = _flat(batch.column("hash"))
    first, last = windows(_flat(batch.column("words"))[0], ends, min_words)
    at = np.unique(minima(hashed, first, last))
    text = np.searchsorted(ends, at, side="right") - 1
    return {"key": batch.column("key").take(pa.array(text)), "value": hashed[at], "place": (at - ends[text]).astype(np.int32)}


def _matched(batch: pa.RecordBatch, min_words: int) -> dict:
    """Windows round the joined positions of texts, as hashes."""
    hashed, ends = _flat(batch.column("hash"))
    counts = _flat(batch.column("words"))[0]
    places, own = _flat(batch.column("places"))
    joined = np.zeros(len(hashed), dtype=bool)
    joined[places + np.repeat(ends[:-1], np.diff(own))] = True
    first, last = windows(counts, ends, min_words)
    here = joined[minima(hashed, first, last)]
    first, last = first[here], last[here]
    text = np.searchsorted(ends, first, side="right") - 1
    lines = np.stack([hashed, _flat(batch.column("more"))[0]], axis=1)
    value = _digests(memoryview(np.ascontiguousarray(lines)).cast("B"), first * 16, (last + 1) * 16)
    # lines are told by their number in the text
    number = _flat(batch.column("number"))[0]
    return {
        "id": batch.column("id").take(pa.array(text)),
        "key": batch.column("key").take(pa.array(text)),
        "a": np.ascontiguousarray(value[:, 0]),
        "b": np.ascontiguousarray(value[:, 1]),
        "first": number[first],
        "last": number[last],
    }


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, key, runs)``: ranges of line numbers to delete, for documents that have any.

    ``key`` is the hash of the text, so that rows with one id are told apart.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    # equal rows need to be looked at once only
    lines = common.durable(
        common.map_arrow(
            named,
            lambda batch: {"id": batch.column(0), "key": batch.column(1)} | lines_of(batch.column(2)),
            "id long, key long, number array<int>, hash array<long>, more array<long>, words array<int>",
        ).filter(F.size("hash") > 0)
    )
    prints = common.durable(common.map_arrow(lines.select(F.struct("id", "key").alias("key"), "hash", "words"), lambda batch: _selected(batch, min_words), "key struct<id:bigint,key:bigint>, value long, place int"))
    often = common.durable(prints.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"))
    places = common.join_counted(prints, often, ["value"]).groupBy("key").agg(F.collect_set("place").alias("places"))
    round_them = lines.join(places.select(F.col("key.id").alias("_id"), F.col("key.key").alias("_key"), "places"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    found = common.durable(
        common.map_arrow(round_them.select("id", "key", "number", "hash", "more", "words", "places"), lambda batch: _matched(batch, min_words), "id long, key long, a long, b long, first int, last int")
    )
    earliest = common.durable(found.groupBy("a", "b").agg(F.min(F.struct("id", "first", "last")).alias("least"), F.count("*").alias("n")).filter("n > 1"))
    later = common.join_counted(found, earliest, ["a", "b"]).filter(~F.col("id").eqNullSafe(F.col("least.id")) | (F.col("first") > F.col("least.last")))
    return later.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))


def marked(docs: DataFrame, name: str = "runs", id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` and, last, an array of ranges (first, last) of the lines to delete, null where nothing goes.

    If ``docs`` has a column ``name``, the new one gets underscores before its name.
    Only documents that may have such lines are shuffled (``common.suspects``).
    """
    found = common.durable(repeated(docs, id_col, text_col, min_words))
    name = common.free_name(docs, name)
    run_id, run_key, run = (common.free_name(docs, c) for c in ("_run_id", "_run_key", "_runs"))
    runs = found.select(F.col("id").alias(run_id), F.col("key").alias(run_key), F.col("runs").alias(run))
    row_id, row_key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    asked, clean = common.suspects(docs, F.xxhash64(row_id, row_key), found.select(F.xxhash64("id", "key").alias("h")))
    met = asked.join(runs.hint("shuffle_hash"), row_id.eqNullSafe(F.col(run_id)) & (row_key == F.col(run_key)), "left").select(*docs.columns, F.col(run).alias(name))
    return met.unionByName(clean.withColumn(name, F.lit(None).cast(met.schema[name].dataType)))


def kept_lines(text: F.Column, runs: F.Column) -> F.Column:
    """The text without the lines of ``runs``."""
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists(runs, lambda r: (r.first <= i) & (i <= r.last)))
    return F.when(runs.isNull(), text).otherwise(F.array_join(left, "\n"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with later repeated runs cut out; a document that loses all its words goes with ``drop_emptied``."""
    name = common.free_name(docs, "_cut")
    out = marked(docs, name, id_col, text_col, min_words)
    lost = F.col(name).isNotNull()
    out = out.withColumn(text_col, kept_lines(F.col(text_col), F.col(name)))
    if drop_emptied:
        out = out.filter(~lost | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.drop(name)
