"""Sequences of bounded length, packed by shortest-pack-first over the histogram of lengths.

A document's ids, with the separator after them, are cut into whole sequences
of ``capacity`` ids and a tail.  Only the histogram of the tails' lengths reaches
the driver (``capacity`` numbers at most, whatever the input).  There lengths are
placed longest first, each into the pack that holds least and has room for it,
for all packs of one pattern at once: a pattern is what a pack holds, and has a
count.

Where packs would stay with padding, the shortest of them are dissolved: their
tails are cut into powers of two (the binary digits of a length), which fill the
room of the others, again longest first; what finds no room makes sequences of a
power of two, which need no padding.  As few packs are dissolved as bring the
padding under ``padding`` times all ids, so most tails stay whole.

Patterns are joined back by rank: the n-th tail of a length takes the n-th place
that the patterns have for that length.  Ranks are numbers within a task, written
with the rows, and the number of equal lengths in the tasks before it; no length's
rows meet in one task.

A null or empty text is the separator alone.  Repeated rows are documents of
their own; the id may be null.  A text of any length is one document, encoded in
halves.  The separator ``<|endoftext|>`` written in a text is one id.  An empty
table gives no sequences.  Columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as common
from . import bpe

CAPACITY = 1024
#: Most padding, as a share of all ids.
PADDING = 0.002
SEPARATOR = 0
#: Pieces that a worker remembers: this vocabulary cuts more words than that of ``bpe``.
REMEMBERED = 250_000
SPECIAL = b"<|endoftext|>"

Pattern = tuple[tuple[int, int, bool], ...]  #: runs of (length, times, whether it is a cut piece)


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def digits(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packs:
    """Counts of packs by the room that they have left and their pattern."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.room: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]
        self.shut: dict[Pattern, int] = defaultdict(int)  # takes nothing more

    def copy(self) -> Packs:
        new = Packs(self.capacity)
        new.room = [dict(x) for x in self.room]
        new.shut = defaultdict(int, self.shut)
        return new

    def add(self, room: int, runs: Pattern, count: int) -> None:
        if count:
            self.room[room][runs] = self.room[room].get(runs, 0) + count

    def place(self, length: int, count: int, cut: bool) -> None:
        """Each of ``count`` pieces goes to the shortest pack that has room; with none, packs are opened.

        Packs opened for cut pieces are shut at once: powers of two of equal pieces.
        """
        top = self.capacity
        while count:
            while top >= length and not self.room[top]:
                top -= 1
            if top < length:
                return self._open(length, count, cut)
            runs, packs = self.room[top].popitem()
            below = top if self.room[top] else next((r for r in range(top - 1, 0, -1) if self.room[r]), 0)
            times = max(1, min((top - below) // length, top // length, count // packs))
            filled = min(packs, count // times)
            self.add(top, runs, packs - filled)
            last = (length, times, cut)
            if runs and runs[-1][0] == length and runs[-1][2] == cut:
                runs, last = runs[:-1], (length, runs[-1][1] + times, cut)
            self.add(top - times * length, (*runs, last), filled)
            count -= filled * times

    def _open(self, length: int, count: int, cut: bool) -> None:
        whole, rest = divmod(count, self.capacity // length)
        if not cut:
            self.add(self.capacity % length, ((length, self.capacity // length, False),), whole)
            if rest:
                self.add(self.capacity - rest * length, ((length, rest, False),), 1)
            return
        if whole:
            self.shut[((length, self.capacity // length, True),)] += whole
        for times in digits(rest):
            self.shut[((length, times, True),)] += 1

    def open(self) -> list[tuple[int, Pattern, int]]:
        """Packs with padding, those that hold least first."""
        return [(r, p, n) for r in range(self.capacity - 1, 0, -1) if not power_of_two(self.capacity - r) for p, n in sorted(self.room[r].items())]

    def padding(self) -> int:
        return sum(r * n for r, _, n in self.open())

    def patterns(self) -> list[tuple[Pattern, int]]:
        return [(p, n) for found in (*self.room, self.shut) for p, n in sorted(found.items())]

    def dissolved(self, packs: int) -> tuple[Packs, dict[int, int]]:
        """These packs without the ``packs`` shortest open ones, whose tails are cut; and the number of cut tails by length."""
        new, tails = self.copy(), defaultdict(int)
        for room, runs, n in self.open():
            n = min(n, packs)
            if not n:
                break
            packs -= n
            new.room[room][runs] -= n
            if not new.room[room][runs]:
                del new.room[room][runs]
            for length, times, _ in runs:
                tails[length] += times * n
        pieces: dict[int, int] = defaultdict(int)
        for length, n in tails.items():
            for d in digits(length):
                pieces[d] += n
        for length in sorted(pieces, reverse=True):
            new.place(length, pieces[length], True)
        return new, dict(tails)


def packed(histogram: dict[int, int], capacity: int = CAPACITY, padding: float = PADDING) -> tuple[Packs, dict[int, int]]:
    """The packs of a histogram (length -> number of tails), and the number of tails by length that are cut."""
    packs = Packs(capacity)
    for length in sorted(histogram, reverse=True):
        packs.place(length, histogram[length], False)
    allowed = padding * sum(length * n for length, n in histogram.items())
    if packs.padding() <= allowed:
        return packs, {}
    few, many = 0, sum(n for _, _, n in packs.open())  # without any pack that is padded there is no padding
    best = packs.dissolved(many)
    while few + 1 < many:
        some = (few + many) // 2
        tried = packs.dissolved(some)
        if tried[0].padding() <= allowed:
            many, best = some, tried
        else:
            few = some
    return best


PLACES = "length int, low long, high long, shift long, times long, sequence long, place int, begin int, size int"


def places(histogram: dict[int, int], packs: Packs, cut: dict[int, int]) -> list[tuple]:
    """Rows of ``PLACES``: a tail of ``length`` with a rank in [low, high) has its ids [begin, begin + size) in
    sequence ``sequence + (rank + shift) // times`` at ``place + (rank + shift) % times * size``."""
    out: list[tuple] = []
    used: dict[int, int] = defaultdict(int)
    pieces: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)  # by length: low, high, times, sequence, place
    sequence = 0
    ends: dict[int, int] = defaultdict(int)
    for runs, n in packs.patterns():
        place = 0
        for length, times, is_cut in runs:
            if is_cut:
                pieces[length].append((ends[length], ends[length] + n * times, times, sequence, place))
                ends[length] += n * times
            else:
                out.append((length, used[length], used[length] + n * times, -used[length], times, sequence, place, 0, length))
                used[length] += n * times
            place += length * times
        sequence += n
    ends = defaultdict(int)
    for length in sorted(cut):
        low, begin = used[length], 0
        for size in digits(length):
            first, last = ends[size], ends[size] + cut[length]
            ends[size] = last
            for a, b, times, number, place in pieces[size]:
                if a < last and first < b:
                    x, y = max(a, first), min(b, last)
                    out.append((length, low + x - first, low + y - first, first - low - a, times, number, place, begin, size))
            begin += size
        used[length] += cut[length]
    assert all(used[k] == n for k, n in histogram.items())
    return out


@lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[bpe.Codec, int]:
    """Codec of a byte-level vocabulary file, and the id of its special token."""
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    letters = _letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    own = bpe.Codec.of_ranks(ranks)
    own.remembered = REMEMBERED
    return own, special[SPECIAL.decode()]


def ids_of(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, with the separator after them."""
    own, special = vocabulary(path)
    data, offsets = common.raw_texts(column)
    end = np.array([SEPARATOR], dtype=np.uint32)
    for i, j in common.chunks(offsets):
        at = (offsets[i : j + 1] - offsets[i]).tolist()
        text = bytes(data[offsets[i] : offsets[j]])
        if SPECIAL not in text:
            ids, ends = own.encode_texts(text, at)
            ids = ids.astype(np.uint32)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield np.append(ids[a:b], end)
            continue
        for a, b in zip(at[:-1], at[1:]):
            parts = []
            for part in text[a:b].split(SPECIAL):
                parts += [own.encode_texts(part, [0, len(part)])[0].astype(np.uint32), np.array([special], np.uint32)]
            yield np.concatenate([*parts[:-1], end])


def _units(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """A row for each whole sequence and each tail of a document, with its number among the task's of the same length."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common.bounded_batches(docs.sparkSession)
    schema = _parse_datatype_string("start long, length int, doc_tokens long, part int, rank long, crc long, crcs array<long>, ids array<int>")
    schema = type(schema)([named.schema["doc_id"], *schema.fields])
    kinds = list(to_arrow_schema(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            row, start, length, total, crc, crcs, kept = [], [], [], [], [], [], []
            for k, ids in enumerate(ids_of(batch.column(1), path)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                for a in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - a)
                    own = []
                    if n < capacity and not power_of_two(n):
                        b = a
                        for d in digits(n):
                            own.append(zlib.crc32(raw[4 * b : 4 * (b + d)]))
                            b += d
                    row.append(k)
                    start.append(a)
                    length.append(n)
                    total.append(len(ids))
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + n)]))
                    crcs.append(own)
                    kept.append(ids[a : a + n].astype(np.int32) if with_ids else None)
            n = np.array(length, dtype=np.int64)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            rank = np.empty(len(n), dtype=np.int64)
            rank[order] = np.arange(len(n)) - first + seen[n[order]]
            seen += np.bincount(n, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), start, n, total, np.full(len(n), part), rank, crc, crcs, kept]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, kinds)], names=[f.name for f in kinds])

    return named.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, padding: float = PADDING, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, crc, doc_tokens, sequence_id, offset, ids)`` for each piece of each document.

    Sequence ids go from 0 without gaps, as do the offsets in a sequence; ``crc`` is
    the CRC-32 of the piece's ids as little-endian unsigned 32-bit numbers.  Without
    ``with_ids``, ``ids`` is null and no ids are written.  The encoded rows are written
    to the shared folder once; what is shuffled are their numbers.
    """
    if not power_of_two(capacity):
        raise ValueError("the capacity has to be a power of two")
    spark = docs.sparkSession
    units = common.written(_units(docs, path, id_col, text_col, capacity, with_ids))
    counts = common.durable(units.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.createDataFrame(places(histogram, *packed(histogram, capacity, padding)), PLACES)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = units.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") + F.col("shift")
    whole = F.col("size") == F.col("u.length")
    digit = F.bit_count(F.col("u.length") - F.col("begin"))  # binary digits from this piece on
    return (
        ranked.alias("u")
        .join(F.broadcast(table).alias("p"), (F.col("u.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            "doc_id",
            (F.col("start") + F.col("begin")).alias("start"),
            F.col("size").cast("long").alias("length"),
            F.when(whole, F.col("crc")).otherwise(F.element_at("crcs", F.size("crcs") - digit + 1)).alias("crc"),
            "doc_tokens",
            F.expr("sequence + (rank + shift) div times").alias("sequence_id"),
            (F.col("place") + at % F.col("times") * F.col("size")).cast("long").alias("offset"),
            F.slice("ids", F.col("begin") + 1, F.col("size")).alias("ids"),
        )
    )


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = SEPARATOR) -> DataFrame:
    """``(sequence_id, ids, starts, padding)``: each sequence's ids with ``pad`` after them, the offsets at which its pieces start, and the number of pads.

    ``pieces`` are those of ``pack`` with ids.  A sequence of a power of two is not padded.
    """
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    ids = F.flatten(F.col("held.ids"))
    n = F.size(ids)
    missing = F.when(F.bit_count(n) == 1, 0).otherwise(capacity - n)
    return held.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), missing)).alias("ids"), F.col("held.offset").alias("starts"), missing.alias("padding"))
