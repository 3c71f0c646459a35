"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are lower-cased runs of letters, digits and characters beyond ASCII.  A
window is ``window`` consecutive words of an item, or a shorter item's whole
word sequence.  Each document's words stream through the automaton, which
tracks the longest match that ends at each word; where it reaches a window's
length, the window's words are hit and the suffix state names the items.

Most text is far from any item.  So a vectorised scan first finds stretches
that could match at all: at least as many words as the smallest window has, of
which each is an item's word and each adjacent pair an item's pair (by hash
tables without false negatives).  Only these go through the automaton, word by
word, where words are compared themselves.

Items are taken in blocks of about ``block_chars`` characters.  Each block is
collected, built and frozen into flat arrays before the next, so the driver holds one
growing automaton at a time (some 300 bytes a character); up to ``PASS_BLOCKS``
frozen ones (some 30 bytes a character) are sent to the tasks for one pass over the
documents, and more take more passes.  Documents are never shuffled.

Null or empty texts have no words; items without words match nothing; repeated
items count once; an item without an id hits words, but is neither named nor
counted.  Repeated documents have equal results, a very long text is one row's
work, and other columns of the documents stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common
from . import words
from .suffix_automaton import SuffixAutomaton

WINDOW = 10
BLOCK_CHARS = 1_000_000
PASS_BLOCKS = 16
#: Documents with a larger share of hit words are removed whole.
MAX_COVERAGE = 0.5

_MIX = np.uint64(0xD6E8FEB86659FD93)
FOUND = "n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>"


class Matcher:
    """Finds windows of items in texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window = window
        table = words.ALNUM.tobytes()
        split = [(item, [w for w in (text or "").encode().translate(table).split(b"\0") if w]) for item, text in items]
        split = [(item, ws) for item, ws in split if ws]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in split]
        self.least = min((min(window, len(s)) for _, s in sequences), default=window)
        self.automaton = SuffixAutomaton.of(sequences, self.least).frozen()
        self.short: dict[tuple[int, int], set[str]] = {}
        for item, sequence in sequences:
            if len(sequence) < window:
                at = 0
                for symbol in sequence:
                    at = self.automaton.step(at, symbol)
                self.short.setdefault((at, len(sequence)), set()).add(item)
        self.sizes = sorted({size for _, size in self.short})
        self._filters(split)

    def _filters(self, split: list[tuple[str, list[bytes]]]) -> None:
        joined = b"\0".join(w for _, ws in split for w in [*ws, b""])
        folded = np.frombuffer(joined, dtype=np.uint8)
        starts, ends = words.spans(folded, np.array([0, len(folded)]))
        hashed = words.hashes(folded, starts, ends)
        self.bits = np.uint64(64 - min(24, max(17, len(hashed).bit_length() + 5)))
        known = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        known[hashed >> self.bits] = True
        pairs = np.zeros_like(known)
        if len(hashed) > 1:
            inner = np.concatenate([np.r_[np.ones(len(ws) - 1, bool), False] for _, ws in split])[:-1]
            pairs[self._pair(hashed)[inner]] = True
        self.packed = np.packbits(known), np.packbits(pairs)  # tasks unpack them

    @cached_property
    def known(self) -> np.ndarray:
        return np.unpackbits(self.packed[0]).view(bool)

    @cached_property
    def pairs(self) -> np.ndarray:
        return np.unpackbits(self.packed[1]).view(bool)

    def _pair(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed[:-1] * _MIX + hashed[1:]) * _MIX >> self.bits

    def stretches(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges [i, j) that could hold a window; ``first``: index of each text's first word."""
        known = self.known[hashed >> self.bits]
        follows = np.zeros(len(hashed), dtype=bool)  # the word continues the stretch of the one before
        if len(hashed) > 1:
            follows[1:] = known[1:] & known[:-1]
            at = np.flatnonzero(follows[1:])
            follows[1:][at] = self.pairs[(hashed[at] * _MIX + hashed[at + 1]) * _MIX >> self.bits]
        follows[first[first < len(hashed)]] = False
        begins = np.flatnonzero(known & ~follows)
        stops = np.flatnonzero(known & ~np.r_[follows[1:], False]) + 1
        long = stops - begins >= self.least
        return begins[long], stops[long]

    def windows(self, sequence: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(start, end, items) of each window in a stretch of words, by its last word."""
        out, get = [], self.vocabulary.get
        automaton = self.automaton
        for i, (at, size) in enumerate(automaton.matches([get(w, -1) for w in sequence])):
            if size >= self.window:
                out.append((i + 1 - self.window, i + 1, automaton.items[automaton.suffix(at, self.window)]))
            for short in self.sizes:
                if short <= size and (found := self.short.get((automaton.suffix(at, short), short))):
                    out.append((i + 1 - short, i + 1, found))
        return out

    def batch(self, column: pa.Array) -> list[dict]:
        """A row of ``FOUND`` for each text; starts and ends are code points of the removed spans."""
        data, offsets = common.raw_texts(column)
        whole = np.frombuffer(data, dtype=np.uint8)
        rows: list[dict] = []
        for i, j in common.chunks(offsets):
            raw = whole[offsets[i] : offsets[j]]
            at = offsets[i : j + 1] - offsets[i]
            folded = words.ALNUM[raw]
            starts, ends = words.spans(folded, at)
            first = words.per_text(starts, at)
            counts = np.diff(first)
            begins, stops = self.stretches(words.hashes(folded, starts, ends), first[:-1])
            owner = np.searchsorted(first, begins, side="right") - 1
            found: dict[int, list] = {}
            for doc, a, b in zip(owner.tolist(), begins.tolist(), stops.tolist(), strict=True):
                text = folded[starts[a] : ends[b - 1]].tobytes()
                got = self.windows([text[x:y] for x, y in zip((starts[a:b] - starts[a]).tolist(), (ends[a:b] - starts[a]).tolist(), strict=True)])
                if got:
                    found.setdefault(doc, []).extend((a + x, a + y, items) for x, y, items in got)
            for k, n in enumerate(counts.tolist()):
                row = {"n_words": n, "n_hit": 0, "items": [], "starts": [], "ends": []}
                if k in found:
                    merged = _union((x, y) for x, y, _ in found[k])
                    row["n_hit"] = sum(y - x for x, y in merged)
                    row["items"] = sorted(set().union(*(items for _, _, items in found[k])) - {None})
                    points = np.cumsum((raw[at[k] : at[k + 1]] & 0xC0) != 0x80)  # code points up to and with each byte
                    row["starts"] = [int(points[starts[x] - at[k]]) - 1 for x, _ in merged]
                    row["ends"] = [int(points[ends[y - 1] - 1 - at[k]]) for _, y in merged]
                rows.append(row)
        return rows


def _union(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def matchers(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Matcher]:
    """A matcher for each block of items, each of about ``block_chars`` characters; one block at a time is collected."""
    own = common.durable(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct())
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars) or 1
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for b in range(blocks):
        yield Matcher([(r.item, r.text) for r in own.filter(place == b).collect()], window)


def overlaps(docs: DataFrame, items: DataFrame, name: str = "overlap", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` and, last, a struct column of type ``FOUND``: hits, items and spans to remove.

    It is called ``name``; if ``docs`` has a column of that name, the new one gets underscores before its name.
    """
    name = common.free_name(docs, name)
    found, before = matchers(items, window=window, block_chars=block_chars), None
    while block := list(islice(found, PASS_BLOCKS)):

        def rows(batch: pa.RecordBatch, block=block, before=before) -> list[dict]:
            texts = batch.column(0).cast(pa.string())
            parts = [batch.column(1).to_pylist()] if before else []
            parts += [matcher.batch(texts) for matcher in block]
            return parts[0] if len(parts) == 1 else [_joined(own, text) for own, text in zip(zip(*parts, strict=True), texts, strict=True)]

        held = common.free_name(docs, "_next")
        docs = common.append_struct(common.durable(docs) if before else docs, rows, [text_col, *([before] if before else [])], FOUND, held)
        docs = docs.drop(*([before] if before else [])).withColumnRenamed(held, name)
        before = name
    return docs


def _joined(parts: tuple[dict, ...], text: pa.Scalar) -> dict:
    """What several blocks of items found in one text."""
    some = [x for x in parts if x["starts"]]
    if len(some) < 2:
        return some[0] if some else parts[0]
    spans = _union(s for x in some for s in zip(x["starts"], x["ends"], strict=True))
    table, whole = words.ALNUM.tobytes(), text.as_py()
    hit = sum(len([w for w in whole[a:b].encode().translate(table).split(b"\0") if w]) for a, b in spans)
    return {"n_words": parts[0]["n_words"], "n_hit": hit, "items": sorted(set().union(*(x["items"] for x in some))), "starts": [a for a, _ in spans], "ends": [b for _, b in spans]}


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the spans of test items, and without documents that mostly are items.

    A document goes if over ``max_coverage`` of its words are hit; in the others
    the hit spans are cut out.  Documents without hits are unchanged.
    """
    name = common.free_name(docs, "overlap")
    found = overlaps(docs, items, name, text_col, window, block_chars)
    part = F.col(name)
    kept = found.filter(part.n_hit <= max_coverage * part.n_words)
    n = F.size(part.starts)
    # what stands before, between and after the spans
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.substring(
            F.col(text_col),
            F.when(k > 0, F.get(part.ends, k - 1)).otherwise(0).cast("int") + 1,
            (F.when(k < n, F.get(part.starts, k)).otherwise(F.length(text_col)) - F.when(k > 0, F.get(part.ends, k - 1)).otherwise(0)).cast("int"),
        ),
    )
    return kept.withColumn(text_col, F.when(n > 0, F.array_join(pieces, " ")).otherwise(F.col(text_col))).drop(name)
