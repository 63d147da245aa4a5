"""64-bit hashes of all words of a text in a few vectorised passes, without a Python object for any word.

A word's hash is a polynomial over its characters in arithmetic modulo 2^64: differences of running sums,
shifted back to the word's own start by powers of the inverse of an odd base, and mixed. So it does not depend
on where the word stands.
"""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers are kept up to this number; longer texts make their own.
_KEPT = 1 << 16
_powers: list[np.ndarray] = []


def _table(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if _powers and len(_powers[0]) > n:
        return _powers
    size = max(n, _KEPT) + 1
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= _KEPT:
        _powers[:] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def word_hashes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes, in order, of the runs of ``codes`` (characters as integers) where ``inside`` is true."""
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _table(len(codes))
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= up[: len(codes)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
