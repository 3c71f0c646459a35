"""Byte-level BPE as a monoid: halves are encoded alone and joined at their boundary.

Two trees are built, one inside the other.

* A text is cut into halves until leaves of at most ``LEAF_CHARS`` remain.  The
  leaves of many texts are split into pieces (the matches of the tokenizer's
  pattern) by one vectorised pass.  Two neighbours are joined by splitting a
  window round their border anew: it starts at the first piece of the left one
  whose match could have looked at the border, and it grows to the right until
  a piece starts where a piece of the right one starts.  A match depends on no
  text before it, so all later pieces stand.
* A long piece is encoded in halves too.  Joined tokens are the encoding of
  the joined bytes if each adjacent pair of tokens encodes to itself: the first
  merge across a border would also happen in the two tokens at that border
  alone.  So a window of tokens at the border is encoded anew, and grows on the
  side where its outer pair fails.

Short pieces are merged directly and remembered.  Decoding concatenates the
tokens' bytes, leaf by leaf, in order.  Special tokens are never produced; a
null text is an empty one and has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common

LEAF_CHARS = 16_384
LEAF_BYTES = 64
#: Pieces that a worker remembers; the memory is emptied when full.
REMEMBERED = 150_000

# Code points with the property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_NONE = 1 << 60
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point: white space, letter, number or other."""
    import regex

    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    out[WHITE_SPACE] = _SPACE
    return out


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the pieces of each part begin; ``borders``: increasing, the first index of each part and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    first = np.zeros(n + 1, dtype=bool)  # a part begins here
    first[borders] = True
    last = first[1:]  # the part ends after it
    first = first[:-1]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else stands alone, or leads it if it is a blank.
    before = np.zeros(n, dtype=bool)
    before[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~last[:-1]
    start |= before
    at = np.flatnonzero(before)
    start[at[points[at] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece
    quotes = np.flatnonzero((points == 39) & start & ~last)
    if len(quotes):
        one = points[quotes + 1]
        short = quotes[np.isin(one, [115, 116, 109, 100])]
        rest = quotes[(quotes + 2 < n) & ~last[quotes + 1]]
        a, b = points[rest + 1], points[np.minimum(rest + 2, n - 1)]
        long = rest[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]
        for found, size in ((short, 2), (long, 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def _stable(starts: np.ndarray, end: int) -> int:
    """Of pieces with these starts in a text that ends at ``end``: how many would be there whatever came after."""
    stops = np.append(starts[1:], end)
    fixed = (stops < end) & (starts + 3 <= end)
    return int(np.argmin(np.append(fixed, False)))


def join_pieces(points: np.ndarray, left: np.ndarray, right: np.ndarray, border: int, end: int) -> np.ndarray:
    """Piece starts of two neighbouring parts of a text as one part; ``right`` begins at ``border`` and stops at ``end``."""
    keep = _stable(left, border)
    begin = int(left[keep]) if keep < len(left) else border
    grow = 4
    while True:
        stop = int(right[grow]) if grow < len(right) else end
        window = piece_starts(points[begin:stop], np.array([0, stop - begin])) + begin
        if stop == end:
            return np.concatenate([left[:keep], window])
        sure = window[: _stable(window, stop) + 1]  # the next piece's start is sure as well
        meets = np.intersect1d(sure, right, assume_unique=True)
        if len(meets):
            at = meets[0]
            return np.concatenate([left[:keep], window[window < at], right[right >= at]])
        grow *= 2


def tree_pieces(points: np.ndarray, leaves: list[np.ndarray], borders: list[int]) -> np.ndarray:
    """Piece starts of a whole text from those of its leaves, joined pairwise up the tree."""
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    left = tree_pieces(points, leaves[:half], borders[: half + 1])
    right = tree_pieces(points, leaves[half:], borders[half:])
    return join_pieces(points, left, right, borders[half], borders[-1])


def halves(start: int, stop: int, limit: int) -> list[int]:
    """Starts of the leaves of a text, cut into halves."""
    if stop - start <= limit:
        return [start]
    middle = (start + stop) // 2
    return halves(start, middle, limit) + halves(middle, stop, limit)


class Codec:
    """Encodes and decodes by a file of ranks."""

    remembered: int | None = None  #: instead of ``REMEMBERED``

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self._set({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Codec:
        """A codec of tokens whose ids are their ranks."""
        new = cls.__new__(cls)
        new._set(ranks)
        return new

    def _set(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        decimals = [b"%d," % i for i in range(size)]
        self.decimal_sizes = np.array([len(d) for d in decimals], dtype=np.int64)
        self.decimal_places = np.cumsum(self.decimal_sizes) - self.decimal_sizes
        self.decimals = np.frombuffer(b"".join(decimals), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        """Remembered pieces: their number by bytes, and by number where their ids stand in ``pool``."""
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.place = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of ``piece`` by merging its lowest-ranked, then leftmost, adjacent pair while there is one."""
        if len(piece) > LEAF_BYTES:
            return self._merge_long(piece)
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while scores:
            least = min(scores)
            if least == none:
                break
            i = scores.index(least)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs, for windows that had to grow."""
        get, n = self.ranks.get, len(piece)
        stop = list(range(1, n + 1))  # end of the part that begins here, 0 if none does
        back = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            middle = stop[i]
            if not middle or middle >= n or stop[middle] != e or e <= middle:
                continue
            stop[i], stop[middle] = e, 0
            if e < n:
                back[e] = i
                if (r := get(piece[i : stop[e]])) is not None:
                    heapq.heappush(heap, (r, i, stop[e]))
            if i and (r := get(piece[back[i] : e])) is not None:
                heapq.heappush(heap, (r, back[i], e))
        out, i = [], 0
        while i < n:
            out.append(piece[i : stop[i]])
            i = stop[i]
        return out

    def _holds(self, a: bytes, b: bytes) -> bool:
        return self.merge(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of the joined bytes from the tokens of both parts."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(left[len(left) - i :] + right[:j]))
            fine_left = i == len(left) or self._holds(left[-i - 1], window[0])
            fine_right = j == len(right) or self._holds(window[-1], right[j])
            if fine_left and fine_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if fine_left else 2 * i, j if fine_right else 2 * j

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        return [self.ranks[t] for t in self.tree(piece)]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent tokens, ``_NONE`` if they don't merge; -1 stands for no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], _NONE)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pieces, one after the other, and the number of each: all are merged in step."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self.byte_ids[grid], -1)
        done = np.full((len(pieces), width), -1, dtype=np.int64)
        scores = np.full((len(pieces), width), _NONE)
        scores[:, :-1] = self._pair(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        while len(rows):
            at = scores.argmin(axis=1)
            best = scores[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                more = ~over
                rows, ids, scores, at, best = rows[more], ids[more], scores[more], at[more], best[more]
                if not len(rows):
                    break
            own = np.arange(len(rows))
            ids[own, at] = best
            # what stands right of the pair moves one place to the left
            width = ids.shape[1]
            take = np.minimum(columns[:width] + (columns[:width] > at[:, None]), width - 1)
            end = ids[:, -1].copy()
            ids, scores = np.take_along_axis(ids, take, axis=1), np.take_along_axis(scores, take, axis=1)
            ids[:, -1] = np.where(at == width - 1, end, -1)
            scores[:, -1] = _NONE
            scores[own, at] = np.where(at + 1 < width, self._pair(best, ids[own, np.minimum(at + 1, width - 1)]), _NONE)
            inner = np.flatnonzero(at > 0)
            scores[inner, at[inner] - 1] = self._pair(ids[inner, at[inner] - 1], best[inner])
        return done[done >= 0].astype(np.int32), (done >= 0).sum(axis=1)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        for name, size in (("pool", self.used + len(ids)), ("place", first + len(pieces)), ("count", first + len(pieces))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(size, len(held)), dtype=held.dtype)]))
        self.pool[self.used : self.used + len(ids)] = ids
        self.place[first : first + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.count[first : first + len(pieces)] = counts
        self.used += len(ids)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each of these different pieces in the memory, which holds them all then."""
        if len(self.known) > (self.remembered or REMEMBERED):
            self._forget()
        get = self.known.get
        found = [get(p, -1) for p in pieces]
        if -1 in found:
            fresh = [p for p, k in zip(pieces, found) if k < 0]
            whole = [p for p in fresh if p in self.ranks]
            if whole:
                self._remember(whole, np.array([self.ranks[p] for p in whole], dtype=np.int32), np.ones(len(whole), np.int64))
            by_size = sorted((p for p in fresh if p not in self.ranks and len(p) <= LEAF_BYTES), key=len)
            for i in range(0, len(by_size), 4096):  # of similar length
                own = by_size[i : i + 4096]
                self._remember(own, *self.merge_many(own))
            for piece in fresh:
                if len(piece) > LEAF_BYTES and piece not in self.ranks:
                    ids = np.array(self.encode_piece(piece), dtype=np.int32)
                    self._remember([piece], ids, np.array([len(ids)]))
            found = [self.known[p] if k < 0 else k for p, k in zip(pieces, found)]
        return np.array(found, dtype=np.int64)

    def encode_pieces(self, data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of ``data``, which begin ``at`` these bytes, and the number of each piece."""
        sizes = np.diff(np.append(at, len(data)))
        eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
        part = lambda k, i: eights[at[i] + k] & _FIRST[np.minimum(sizes[i] - k, 8)]
        every = np.arange(len(at))
        key = sizes.astype(np.uint64)
        rounds = []
        for k in range(0, int(sizes.max()), 8):
            own = every if not k else np.flatnonzero(sizes > k)
            if k >= 256:  # what long pieces go on with is told apart below
                break
            value = part(k, own)
            rounds.append((k, own, value))
            mixed = (key[own] ^ value) * _MIX
            key[own] = mixed ^ (mixed >> np.uint64(31))
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        like = one[group]
        same = sizes[like] == sizes
        for k, own, value in rounds:
            same[own] &= part(k, like[own]) == value
        same &= (sizes <= 256) | (like == every)
        pieces = [data[a:b] for a, b in zip(at[one].tolist(), (at[one] + sizes[one]).tolist())]
        if not same.all():  # long, or with another piece's key
            alone = np.flatnonzero(~same)
            other: dict[bytes, int] = {p: i for i, p in enumerate(pieces)}
            group[alone] = [other.setdefault(data[at[i] : at[i] + sizes[i]], len(other)) for i in alone.tolist()]
            pieces = list(other)
        number = self.numbers(pieces)[group]
        counts = self.count[number]
        return self.pool[_ranges(self.place[number], counts)], counts

    def encode_texts(self, data: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``data``, one after the other, and where each text's ids begin and end."""
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
        ends = np.searchsorted(place, offsets).tolist()  # code point at which each text begins
        leaves, texts = [], []
        for a, b in zip(ends[:-1], ends[1:]):
            own = halves(a, b, LEAF_CHARS)
            texts.append(own)
            leaves += own
        starts = piece_starts(points, np.unique(np.array([*leaves, len(points)])))
        if len(leaves) > len(texts):
            parts, done = [], 0
            for own, b in zip(texts, ends[1:]):
                if len(own) > 1:
                    borders = [*own, b]
                    cut = np.searchsorted(starts, borders)
                    parts += [starts[done : cut[0]], tree_pieces(points, [starts[x:y] for x, y in zip(cut[:-1], cut[1:])], borders)]
                    done = cut[-1]
            starts = np.concatenate([*parts, starts[done:]])
        ids, counts = self.encode_pieces(data, place[starts])
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, ends)]

    def encode(self, text: str | None) -> list[int]:
        data = (text or "").encode()
        return self.encode_texts(data, [0, len(data)])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, concatenated in order."""
        return self.bytes[_ranges(self.offsets[ids], self.lengths[ids])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, each with a comma after it."""
        return self.decimals[_ranges(self.decimal_places[ids], self.decimal_sizes[ids])].tobytes()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    return Codec(path)


ENCODED = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode_column(column: pa.Array, path: str, with_ids: bool) -> dict[str, list]:
    own = codec(path)
    data, offsets = common.raw_texts(column)
    out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
    for i, j in common.chunks(offsets):
        at = offsets[i : j + 1]
        ids, ends = own.encode_texts(bytes(data[at[0] : at[-1]]), (at - at[0]).tolist())
        whole, decimal = own.decode(ids), own.decimal(ids)
        byte_ends = np.append(0, np.cumsum(own.lengths[ids]))[ends].tolist()
        digit_ends = np.append(0, np.cumsum(own.decimal_sizes[ids]))[ends].tolist()
        ends = ends.tolist()
        for k in range(j - i):
            out["n_tokens"].append(ends[k + 1] - ends[k])
            out["ids"].append(ids[ends[k] : ends[k + 1]] if with_ids else None)
            out["ids_sha256"].append(hashlib.sha256(decimal[digit_ends[k] : max(digit_ends[k], digit_ends[k + 1] - 1)]).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(whole[byte_ends[k] : byte_ends[k + 1]]).hexdigest())
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids, ids_sha256, decoded_sha256)`` for every row; no shuffle.

    ``ids_sha256`` is the digest of the decimal ids joined by commas,
    ``decoded_sha256`` that of the bytes which the ids decode to, so a round
    trip can be checked without them.  Without ``with_ids``, ``ids`` is null.  Repeated
    rows have a row each, an empty table has none; other columns are not read, so their names can't clash.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0)} | encode_column(batch.column(1), path, with_ids)

    return common.map_arrow(named, rows, f"id {named.schema['id'].dataType.simpleString()}, {ENCODED}")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` and, last, a binary column with the bytes of the ids; null ids give null.

    If ``tokens`` has a column ``name``, it stays and the new one gets underscores before its name.
    """

    def rows(batch: pa.RecordBatch) -> list[dict]:
        own = codec(path)
        return [{"bytes": None if ids is None else own.decode(np.array(ids, dtype=np.int64))} for ids in batch.column(0).to_pylist()]

    held, name = common.free_name(tokens, "_held"), common.free_name(tokens, name)
    return common.append_struct(tokens, rows, [ids_col], "bytes binary", held).withColumn(name, F.col(f"{held}.bytes")).drop(held)
