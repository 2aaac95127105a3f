"""Best-two-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so the packing is planned on their histogram: at most `capacity` counts reach the
driver, at any size of the corpus. The plan fills a bin greedily (the largest piece that fits, again and again), then replaces the bin's
smallest piece with two unpacked ones that fit its expanded gap more tightly, and repeats this bin as often as its pieces last. A
piece finds its place from its length and its rank among the pieces of that length; ranks are counted within each task and
offset by the counts of the tasks before it, so no task sees all pieces of a length. Cases:

* null text: empty, one piece that holds the end id alone. Very long texts: cut into pieces of the capacity, the first may be shorter.
* repeated rows, ties and null ids: each row is packed by itself. Empty table: no rows.
* extra columns and clashing names: only the id and the text are read; the result has the operator's own columns.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder, steps

#: The tasks' offsets (one number for each length, in one row a task) are broadcast up to so many bytes, else joined by a shuffle.
BROADCAST_BYTES = 64_000_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins (the lengths in each, largest first) and how many of each, that pack counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    bins = []

    def fitting(gap: int, used: Counter) -> int | None:
        """The largest length of at most gap of which an unused piece is left."""
        for i in range(bisect_right(sizes, gap) - 1, -1, -1):
            if left[sizes[i]] > used[sizes[i]]:
                return sizes[i]
        return None

    def pair(gap: int, least: int, used: Counter) -> tuple[int, int] | None:
        """Two unused pieces whose sum is the largest within (least, gap]."""
        best, low, high = None, 0, bisect_right(sizes, gap) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            free_a, free_b = left[a] - used[a], left[b] - used[b]
            if a + b > gap or free_b < 1:
                high -= 1
            elif free_a < 1 or (a == b and free_a < 2):
                low += 1
            else:
                if a + b > least:
                    best, least = (b, a), a + b
                low += 1
        return best

    while sizes:
        used: Counter = Counter()
        inside, gap = [], capacity
        while (n := fitting(gap, used)) is not None:
            inside.append(n)
            used[n] += 1
            gap -= n
        if gap and len(inside) > 1:
            small = inside[-1]
            used[small] -= 1
            if two := pair(gap + small, small, used):
                inside[-1:] = two
                used.update(two)
            else:
                used[small] += 1
        times = min(left[n] // k for n, k in used.items() if k)
        bins.append((inside, times))
        for n, k in used.items():
            left[n] -= k * times
            if k and not left[n]:
                sizes.remove(n)
    return bins


class Places:
    """Where the piece with a rank among those of its length goes: ranges of ranks for each length."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter = Counter()
        sequence = 0
        for inside, times in bins:
            at = 0
            for n, k in Counter(inside).items():  # equal lengths stand side by side
                rows.setdefault(n, []).append((taken[n], sequence, k, at))
                taken[n] += k * times
                at += n * k
            sequence += times
        self.of = {n: np.array(r, np.int64).T for n, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            first, base, k, at = self.of[int(n)]
            i = np.searchsorted(first, rank[mine], "right") - 1
            turn, place = np.divmod(rank[mine] - first[i], k[i])
            sequence[mine], offset[mine] = base[i] + turn, at[i] + place * n
        return sequence, offset


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids (little-endian 32-bit), sequence_id, offset."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in steps(batches, "text"):
            ids, begin = enc.encode(batch.column("text"))
            total = np.diff(begin) + 1
            count = -(-total // capacity)
            doc = np.repeat(np.arange(len(batch)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = total - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            order = np.argsort(length, kind="stable")
            by = length[order]
            new = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
            run = np.diff(np.append(new, len(by)))
            rank = np.empty(len(by), np.int64)
            rank[order] = np.arange(len(by)) - np.repeat(new, run) + seen[by]
            seen[by[new]] += run
            end, parts = np.array([end_id], enc.type).tobytes(), []
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                stop = min(s + n, int(total[d]) - 1)
                parts.append(ids[begin[d] + s : begin[d] + stop].tobytes() + (end if s + n == total[d] else b""))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binary(parts), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)], ["id", "piece", "start", "length", "ids", "task", "rank"])

    kind = narrow.schema["id"].dataType.simpleString()
    cutted = cut(narrow.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids binary, task int, rank long"))
    counted = cut(cutted.groupBy("task", "length").agg(F.count("*").alias("n")))
    places = Places(plan({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    by_length = firsts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("of"))  # at most capacity entries
    offsets = by_length.select("task", F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda n: F.coalesce(F.try_element_at("of", n.cast("long")), F.lit(0).cast("long"))).alias("of"))
    small = counted.select("task").distinct().count() * (capacity + 1) * 8 <= BROADCAST_BYTES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            sequence, offset = places.find(c["length"].to_numpy(), c["rank"].to_numpy() + c["before"].to_numpy())
            width = encoder(tokenizer_path).type
            ids = binary([np.frombuffer(x.as_buffer(), width).astype("<u4").tobytes() for x in c["ids"]])
            yield pa.RecordBatch.from_arrays([c["id"], c["piece"], c["start"], c["length"], ids, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    joined = cutted.join(F.broadcast(offsets) if small else offsets, "task").withColumn("before", F.get("of", F.col("length").cast("int"))).drop("of")
    return joined.mapInArrow(placed, f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long").withColumnRenamed("id", id_col)
