"""Words of UTF-8 texts as arrays over the bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The multiplier of the polynomial word hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at once.
BLOCK = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, base, dtype=np.uint64), out=out)
    return np.concatenate([np.ones(1, np.uint64), out[:-1]])


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n; kept for the largest power of two so far."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def byte_table(is_word, lower: bool = True) -> np.ndarray:
    """For each byte, what a word holds in its place: 0 outside of words."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        low = b + 32 if lower and 65 <= b <= 90 else b
        table[b] = low if is_word(low) else 0
    return table


#: Letters, digits and everything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

def spans(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, where ``folded`` is not 0; words end with their text."""
    inside = folded != 0
    if len(folded) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(folded))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: equal bytes have equal hashes wherever they stand.

    Spans one after the other are taken a block of ``BLOCK`` bytes at a time, so that
    a long text costs no more memory than a block, or its longest span.
    """
    if len(folded) > BLOCK and len(starts) > 1 and bool(np.all(starts[1:] >= ends[:-1])):
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
            out.append(_hashes(folded[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]))
            i = j
        return np.concatenate(out)
    return _hashes(folded, starts, ends)


def _hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(folded)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(folded * powers(BASE, n), out=total[1:])
    value = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and at the end the number of words."""
    return np.searchsorted(starts, offsets, side="left")
