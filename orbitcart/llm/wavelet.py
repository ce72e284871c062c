"""Wavelet matrix over small class codes: rank of any class before any position, in batches.

Codes of two bits are stored as two bit levels, the high bit first; after each level the codes
are partitioned stably by that bit. A level keeps its bits in 64-bit words and the number of
ones before each word, so a rank is one lookup and one popcount a level, and all queries of a
call are answered by a few NumPy steps.
"""

from __future__ import annotations

import numpy as np


class BitLevel:
    """Bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """``rank(c, at)``: how many of the first ``at`` codes are ``c`` (codes 0 to 3)."""

    LEVELS = (1, 0)

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.levels = []
        for shift in self.LEVELS:
            bits = (codes >> shift) & 1 == 1
            self.levels.append(BitLevel(bits))
            codes = np.concatenate([codes[~bits], codes[bits]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(1, np.int64), at
        for level, shift in zip(self.levels, self.LEVELS):
            if code >> shift & 1:
                low, high = level.zeros + level.ones(low), level.zeros + level.ones(high)
            else:
                low, high = low - level.ones(low), high - level.ones(high)
        return high - low
