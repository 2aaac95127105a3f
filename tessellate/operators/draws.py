"""The uniforms of `weighted.uniform` for arrays of units and many draws at once: MD5 in NumPy, over all lanes of a block together.

A draw's text is tag~draw~unit. It is one block of MD5 (at most 55 bytes) in nearly all cases, so the words that the units fill are laid out once and a draw only
adds its own; longer texts go through hashlib. Only the first 32 bits of a digest are wanted, which are settled three steps before its end."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that each task may hold for its stretch of the draws: they are broadcast, some 30 bytes each.
IN_PLACE = 2_000_000
#: Rows of an array in which they are broadcast.
IN_A_ROW = 10_000
#: Lanes that are hashed together: so many that calls do not count, and few enough for the cache.
LANES = 16_384
#: Bytes of a text that one block of MD5 holds.
ONE_BLOCK = 55
SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
LEFT, RIGHT = [np.uint32(s) for s in SHIFTS], [np.uint32(32 - s) for s in SHIFTS]


def below(share: float) -> np.uint32:
    """bits < below(share) is uniform < share, for shares under 1."""
    return np.uint32(math.ceil(share * 2**32))


def as_uniform(bits: np.ndarray) -> np.ndarray:
    return bits / float(1 << 32)


def first_bits(words: dict[int, np.ndarray | int], lanes: int) -> np.ndarray:
    """The first 32 bits of the MD5 of each lane's block, as a number; words that are not given are 0."""
    a, b, c, d = (np.full(lanes, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, r = np.empty(lanes, np.uint32), np.empty(lanes, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
            at = 7 * i % 16
        t += a
        w = words.get(at, 0)
        if isinstance(w, int):
            t += np.uint32((SINES[i] + w) & 0xFFFFFFFF)
        else:
            t += w
            t += np.uint32(SINES[i])
        np.left_shift(t, LEFT[i], out=r)
        t >>= RIGHT[i]
        r |= t
        r += b
        a, b, c, d, r = d, r, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


class Lanes:
    """Up to LANES units."""

    def __init__(self, units: pa.Array):
        texts = units.cast(pa.string())
        there, self.n = texts.is_valid().to_numpy(zero_copy_only=False), len(texts)
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.n + 1]
        data, lengths = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.where(there, np.diff(starts), 0)
        #: What follows the draw: nothing for a missing unit, as concat_ws has it; then the bit that ends a text.
        self.sizes = np.where(there, lengths + 1, 0).astype(np.uint32)
        self.longest, self._laid = int(self.sizes.max(initial=0)), {}
        self.tails = np.zeros((self.n, self.longest + 1), np.uint8)
        self.tails[there, :1] = ord("~")
        for k in range(self.longest - 1):
            some = lengths > k
            self.tails[some, k + 1] = data[starts[:-1][some] + k]
        self.tails[np.arange(self.n), self.sizes] = 0x80

    def laid(self, at: int) -> np.ndarray:
        """The words of the units' tails from byte `at` of a word on."""
        if at not in self._laid:
            text = np.zeros((self.n, -(-(at + self.longest + 1) // 4) * 4), np.uint8)
            text[:, at : at + self.longest + 1] = self.tails
            self._laid[at] = np.ascontiguousarray(text.view("<u4").T)
        return self._laid[at]

    def bits(self, tag: str, first: int, count: int, only: np.ndarray | None = None) -> np.ndarray:
        """The bits of the draws first, first + 1, ... (rows) for the units (columns); with `only`, those of its places in their order. The draws have equally many digits."""
        heads = [f"{tag}~{draw}".encode() for draw in range(first, first + count)]
        size = len(heads[0])
        if size + self.longest > ONE_BLOCK:
            of = lambda h: [int.from_bytes(hashlib.md5(h + x[:k].tobytes()).digest()[:4], "big") for x, k in zip(self.tails, self.sizes, strict=True)]
            long = np.array([of(h) for h in heads], np.uint32).reshape(count, self.n)
            return long if only is None else long[only]
        whole, laid = size // 4, self.laid(size % 4)
        head = np.frombuffer(b"".join(h.ljust(4 * whole + 4, b"\0") for h in heads), "<u4").reshape(count, whole + 1)
        pick = (lambda w: w.ravel()) if only is None else (lambda w: w[only])
        every = lambda w: pick(np.broadcast_to(w, (count, self.n)))
        words = {k: int(head[0, k]) if (head[:, k] == head[0, k]).all() else every(head[:, k, None]) for k in range(whole)}
        words[whole] = every(head[:, whole, None] | laid[0])
        words |= {whole + k: every(laid[k]) for k in range(1, len(laid))}
        ends = (self.sizes + np.uint32(size)) * np.uint32(8)
        words[14] = int(ends[0]) if (ends == ends[0]).all() else every(ends)
        out = first_bits(words, self.n * count if only is None else int(only.sum()))
        return out.reshape(count, self.n) if only is None else out


def blocks(first: int, last: int, lanes: int) -> Iterator[tuple[int, int]]:
    """(draw, count): the draws from first to before last in blocks of at most LANES lanes, whose draws have equally many digits."""
    while first < last:
        count = min(last - first, max(1, LANES // max(1, lanes)), 10 ** len(str(first)) - first)
        yield first, count
        first += count


class Units:
    """Any number of units."""

    def __init__(self, units: pa.Array):
        self.n, self.parts = len(units), [Lanes(units.slice(k, LANES)) for k in range(0, len(units), LANES)]

    def bits(self, tag: str, first: int, count: int) -> np.ndarray:
        return np.concatenate([p.bits(tag, first, count) for p in self.parts], axis=1)


def for_stretches(rows: DataFrame, draws: int, of: Callable[[pa.StructArray, int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `of` makes of all rows (at least one, at most IN_PLACE) for each task's stretch of the draws: the rows are broadcast as arrays, nothing is shuffled for a draw."""
    spark = rows.sparkSession
    tasks = min(draws, spark.sparkContext.defaultParallelism * 4)
    packs = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, IN_PLACE // IN_A_ROW)))).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            task = batch["id"][0].as_py()
            held.append(batch["rows"].flatten())
        if held:
            yield from of(pa.concat_arrays(held), task * draws // tasks, (task + 1) * draws // tasks)

    return spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(packs)).mapInArrow(run, schema)
