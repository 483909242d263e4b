"""Words and their hashes in arrays of bytes, without an object for each word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_power: list[np.ndarray] = []

IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, np.uint64)[LOWER]


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64; kept, and grown in doubling."""
    if not _power or len(_power[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _power[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _power


class RangeHash:
    """Polynomial hashes modulo 2**64 of ranges of bytes, with A-Z in lower case, or of ranges of numbers as they are."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        values = _BYTE_VALUE[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64) + np.uint64(1), 9)
        self._summed = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[: len(data)], out=self._summed[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._summed[ends] - self._summed[starts]) * self._down[starts], 5)


def word_ranges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run that is ``inside``, cut at ``offsets``, and the number of runs in each text."""
    cuts = np.zeros(len(inside) + 1, bool)
    cuts[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cuts[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cuts[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


class HashTable:
    """The places of sorted distinct 64-bit hashes, found from where the hashes with the same first bits begin."""

    def __init__(self, hashes: np.ndarray):
        self._bits = max(1, (4 * len(hashes)).bit_length())
        first = (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        self._begin = np.searchsorted(first, np.arange(1 << self._bits)).astype(np.int32)
        self._longest = int(np.bincount(first).max()) if len(first) else 0
        self._padded = np.r_[hashes, np.uint64(0xFFFFFFFFFFFFFFFF)]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table (0 if it isn't there), and whether it is there."""
        at = self._begin[(hashes >> np.uint64(64 - self._bits)).astype(np.int64)]
        for _ in range(self._longest):
            at += self._padded[at] < hashes
        there = (self._padded[at] == hashes) & (at < len(self._padded) - 1)
        return np.where(there, at, 0), there
