"""Words and their 64-bit hashes, for a whole batch of texts at a time (numpy over the bytes of UTF-8)."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts of one step have so many bytes together; the arrays over them take about 60 times as much.
STEP_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that stand one after the other in data: hash, first byte, end, and the first word of each text (and the end)."""
    inside = of_word[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint64), start, end, np.zeros(len(offsets), np.int64)
    begin = np.cumsum(n) - n
    place = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
    sums = np.add.reduceat(_VALUES[data[inside]] * powers(_STEP, int(n.max()))[place], begin)
    return mix(sums + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end, np.searchsorted(start, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each place on; the last k - 1 places have none."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * _STEP + hashes[j : j + len(out)] + np.uint64(j + 1))
    return out
