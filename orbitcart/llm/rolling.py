"""Rolling hashes of byte strings, vectorised over all positions of one text.

H(i, n) = sum over j < n of code(byte i+j) * B^(n-1-j) modulo 2^64, with random 64-bit codes
of the bytes and an odd B, taken from prefix sums of code * B^-position.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINAL = np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(32)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of the substrings of one byte string."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * down[:n], out=self.sums[1:])
        self.up = up

    def windows(self, size: int) -> np.ndarray:
        """The hash of every substring of ``size`` bytes, by start."""
        count = len(self.sums) - size
        return self._final((self.sums[size:] - self.sums[:count]) * self.up[:count])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the substrings [start, end), position-independent; lengths are hashed too."""
        own = (self.sums[end] - self.sums[start]) * self.up[start]
        return self._final(own + (end - start).astype(np.uint64) * _FINAL)

    @staticmethod
    def _final(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _HALF)) * _FINAL
        return h ^ (h >> _HALF)


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` (a power of 2) values: the position of its leftmost smallest one."""
    keys = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while step < size:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
