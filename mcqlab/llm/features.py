"""Hashed features of whole texts, over the bytes of many texts at once.

Sums per text are differences of running sums, so no feature crosses texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mcqlab.llm.common import MIX, mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and all of non-ASCII characters.
WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_low:_high] = True
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    return _powers(max(1 << 16, 1 << (n - 1).bit_length()))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64, n + 1 of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), alike for alike content wherever it stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of each lower-cased word, and n + 1 offsets of words per text."""
    inside = WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = mixed(spans(prefix_hashes(BYTE_VALUES[LOWER[data]]), s, e) + (e - s).astype(np.uint64))
    return hashes, s, e, np.searchsorted(s, offsets)


def gram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes (n up to 7) that start at each place where n are left."""
    m = max(0, len(data) - n + 1)
    x = np.full(m, n, np.uint64)
    for k in range(n):
        x = x << np.uint64(8) | data[k : k + m]
    return (x * MIX >> np.uint64(64 - bits)).astype(np.int64)


def text_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] for each text."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    last = np.minimum(np.maximum(last, first), len(values))
    return total[last] - total[np.minimum(first, last)]
