"""Interning of byte strings in an open-addressed NumPy table.

Many strings, given as (start, length) in one byte buffer, are put into a table of a power of
two slots. The key of a string is its xxhash64; a string probes slot key, key + 1, ... until
it meets an empty slot, which the first such string takes, or an entry with its key, its length
and its bytes. Strings of equal bytes therefore share an entry and others never do, whatever
their hashes. All strings probe together, in rounds over those not yet placed.
"""

from __future__ import annotations

import numpy as np

# The primes of xxhash64 and the polynomial of the reflected crc32.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
CRC_POLYNOMIAL = 0xEDB88320
#: Bytes after the strings' buffer that reading whole lanes may touch.
PADDING = 8


def lanes(data: np.ndarray) -> np.ndarray:
    """For each position of ``data`` but the last 7 the eight bytes from there as a little-endian integer."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return x


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def xxhash64(eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each string; ``eight`` are the buffer's ``lanes``."""
    out, at = np.full(len(start), P5), start.copy()
    long = np.flatnonzero(length >= 32)
    if len(long):
        acc = np.empty((4, len(long)), np.uint64)
        acc[:] = np.array([[(int(P1) + int(P2)) % 2**64], [int(P2)], [0], [2**64 - int(P1)]], np.uint64)
        live = np.arange(len(long))
        while len(live):
            which = long[live]
            for lane in range(4):
                acc[lane, live] = _round(acc[lane, live], eight[at[which] + 8 * lane])
            at[which] += 32
            live = live[start[which] + length[which] - at[which] >= 32]
        mixed = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for lane in range(4):
            mixed = (mixed ^ _round(np.zeros(1, np.uint64), acc[lane])) * P1 + P4
        out[long] = mixed
    out += length.astype(np.uint64)
    left = start + length - at
    for _ in range(3):
        some = np.flatnonzero(left >= 8)
        out[some] = _rotate(out[some] ^ _round(np.zeros(1, np.uint64), eight[at[some]]), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    out[some] = _rotate(out[some] ^ (eight[at[some]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero(left > 0)
        out[some] = _rotate(out[some] ^ (eight[at[some]] & np.uint64(0xFF)) * P5, 11) * P1
        at[some] += 1
        left[some] -= 1
    out = (out ^ out >> np.uint64(33)) * P2
    out = (out ^ out >> np.uint64(29)) * P3
    return out ^ out >> np.uint64(32)


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(CRC_POLYNOMIAL), crc >> 1)
    return crc


CRC_TABLE = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each string, byte by byte over all strings long enough."""
    order = np.argsort(-length, kind="stable")
    at, longest = start[order], -length[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for i in range(int(length.max(initial=0))):
        live = int(np.searchsorted(longest, -i, "left"))  # strings longer than i bytes
        crc[:live] = CRC_TABLE[(crc[:live] ^ data[at[:live] + i]) & 0xFF] ^ crc[:live] >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _equal(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings of equal lengths at ``a`` and ``b`` have equal bytes."""
    short = np.minimum(length, 8).astype(np.uint64)
    mask = np.where(short == 8, ~np.uint64(0), (np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1))
    same = ((eight[a] ^ eight[b]) & mask) == 0
    live, offset = np.flatnonzero(same & (length > 8)), 8
    while len(live):
        step = np.minimum(offset, length[live] - 8)  # the last lane ends with the string
        same[live] = eight[a[live] + step] == eight[b[live] + step]
        offset += 8
        live = live[same[live] & (length[live] > offset)]
    return same


def intern(eight: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entries, slots): the index of the string that stands for each entry, and each string's entry number."""
    n = len(start)
    keys = xxhash64(eight, start, length) if keys is None else keys
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, -1, np.int32)
    owner = np.empty(n, np.int32)
    waiting, slot = np.arange(n, dtype=np.int32), (keys & np.uint64(size - 1)).astype(np.int64)
    while len(waiting):
        holder = table[slot]
        free = np.flatnonzero(holder < 0)
        if len(free):  # one of the strings at an empty slot takes it
            table[slot[free]] = waiting[free]
            holder[free] = table[slot[free]]
        match = (keys[holder] == keys[waiting]) & (length[holder] == length[waiting])
        check = np.flatnonzero(match)
        match[check] = _equal(eight, start[holder[check]], start[waiting[check]], length[waiting[check]])
        owner[waiting[match]] = holder[match]
        waiting, slot = waiting[~match], (slot[~match] + 1) & (size - 1)
    entries = table[table >= 0]
    number = np.empty(n, np.int32)
    number[entries] = np.arange(len(entries), dtype=np.int32)
    return entries, number[owner]
