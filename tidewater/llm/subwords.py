"""Character n-grams of words, hashed into buckets, for many words at once."""

from __future__ import annotations

import numpy as np

from . import words

LEAST, MOST = 3, 6
BITS = 18


def buckets(pieces: list[bytes], least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, one word after the other, and where each word's begin.

    A word is taken with a mark before and after it; its n-grams of ``least`` to
    ``most`` characters and the whole marked word go into ``2 ** bits`` buckets.
    """
    n = len(pieces)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    raw = np.frombuffer(b"<" + b"><".join(pieces) + b">", dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, n) + 2
    ends = np.cumsum(sizes)
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte at which each character begins
    first = np.searchsorted(chars, ends - sizes)  # first character of each word
    last = np.searchsorted(chars, ends)
    owner = np.repeat(np.arange(n), last - first)
    at = np.arange(len(owner))
    starts, stops, whose = [ends - sizes], [ends], [np.arange(n)]
    for size in range(least, most + 1):
        own = at[at + size <= last[owner]]
        own = own[(own + size < last[owner[own]]) | (own > first[owner[own]])]  # not the whole word again
        starts.append(chars[own])
        stops.append(chars[own + size])
        whose.append(owner[own])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    hashed = words.hashes(raw, np.concatenate(starts)[order], np.concatenate(stops)[order])
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), np.append(0, np.cumsum(np.bincount(whose, minlength=n)))
