"""Line dedup by overlapping three-line windows.

The lines of a document that hold a word are taken in order; a line of more than `LONG` words is first wrapped behind the words that end a sentence
(in `.`, `!` or `?`), so that a passage is found wherever in a long line it stands. Each run of three lines is a window, known by the words of its lines
(128 bits of hashes). A window made of wrapped pieces alone counts from `LEAST` words on, as short sentences repeat by chance. A window's first
occurrence in the corpus (least id, then place) stays; the lines that later occurrences cover are removed, overlaps merged. Hashes
are counted with partial sums, only windows that repeat meet their occurrences again, and texts are shuffled once, to meet their
positions. A passage of fewer than three lines or sentences is not found. Cases:

* null and empty texts, and documents of fewer than three such lines: no window, unchanged. Very long texts: whole.
* ties: null ids come last; rows with equal ids are ordered by the hash of their texts. Repeated rows (same id and text) are one
  document seen twice and come out alike, both with the first occurrence if it is theirs. Empty table: no rows.
* extra columns and clashing names: carried; every column that is added, for a while or for good, has a name the table does not use.
* a document of which lines are removed loses its blank lines too; one without repeats is returned as it is, byte for byte.
* a hot window (a passage in a third of all rows): its first occurrence is a partial minimum; its occurrences meet it in an inner join
  with one row a window, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .hashing import NOT_SPACE, STEP_BYTES, grams, mix, words
from .tokens import flat, steps

#: Words of the longest line that is not wrapped, and of the shortest window of wrapped pieces.
LONG, LEAST = 24, 13
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True


@dataclass
class Lines:
    """The lines of some texts: two hashes of each one's words, their number, whether it is a whole line, the number of the line it is of, its bytes; and where each text's begin (and the end)."""

    hashes: np.ndarray
    checks: np.ndarray
    words: np.ndarray
    whole: np.ndarray
    of_line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray
    data: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Lines:
        data, offsets, _ = flat(texts)
        hashes, start, end, begin = words(data, offsets, NOT_SPACE)
        if not len(hashes):
            none = np.zeros(0, np.int64)
            return Lines(none.view(np.uint64), none.view(np.uint64), none, none > 0, none, none, none, np.zeros(len(offsets), np.int64), data)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
        newlines = np.flatnonzero(data == 10)
        line = np.searchsorted(newlines, start)
        new_line = np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))
        size = np.diff(np.append(np.flatnonzero(new_line), len(hashes)))
        wrapped = np.append(False, _SENTENCE_END[data[end[:-1] - 1]]) & np.repeat(size > LONG, size)
        first = np.flatnonzero(new_line | wrapped)
        n = np.diff(np.append(first, len(hashes)))
        opens = new_line[first]
        closes = np.append(opens[1:], True)
        place = mix((np.arange(len(hashes)) - np.repeat(first, n) + 1).astype(np.uint64))
        key = lambda salt: mix(np.add.reduceat(mix(hashes ^ mix(place + np.uint64(salt))), first) + n.astype(np.uint64))
        line_start = np.maximum(np.append(0, newlines + 1)[line], offsets[doc])[first]
        line_end = np.minimum(np.append(newlines, len(data))[line], offsets[doc + 1])[first]
        return Lines(
            key(0x2545F4914F6CDD1D), key(0x9E6C63D0876A9A35), n, opens & closes, np.cumsum(opens), np.where(opens, line_start, start[first]),
            np.where(closes, line_end, np.append(start[first[1:]], 0)), np.searchsorted(first, begin), data,
        )


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs: id, text_hash, text. Per window: window and check (its hashes), id, text_hash, at (its first line's number among the lines with a word)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            x = Lines.of(batch.column("text"))
            made, check = grams(x.hashes, size), grams(x.checks, size)
            doc = np.repeat(np.arange(len(batch)), np.diff(x.begin))[: len(made)]
            at = np.arange(len(made))
            over = lambda counts: np.append(0, np.cumsum(counts))[at + size] - np.append(0, np.cumsum(counts))[at]  # noqa: E731, B023
            good = (at + size <= x.begin[doc + 1]) & ((over(x.words) >= LEAST) | (over(x.whole) > 0))
            row = pa.array(doc[good])
            yield pa.RecordBatch.from_arrays([pa.array(made[good].view(np.int64)), pa.array(check[good].view(np.int64)), batch.column("id").take(row), batch.column("text_hash").take(row), pa.array((at - x.begin[doc])[good].astype(np.int32))], ["window", "check", "id", "text_hash", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(found, f"window long, check long, id {kind}, text_hash long, at int")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> tuple[DataFrame, str]:
    """docs with one column more (its name comes second): an array of the lines where later occurrences begin, null if there is none."""
    name, key, of_id, of_hash = (free_name(docs, x) for x in ("repeated_at", "text_hash_of_row", "repeated_id", "repeated_hash"))
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    seen = cut(windows(keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(key).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text")), size))
    where = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"), F.col("at").alias("at"))
    first = seen.groupBy("window", "check").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = seen.join(first, ["window", "check"]).filter(~F.col("first").eqNullSafe(where))
    at = later.groupBy(F.col("id").alias(of_id), F.col("text_hash").alias(of_hash)).agg(F.collect_set("at").alias(name))
    return keyed.join(at, F.col(f"`{id_col}`").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_hash)), "left").drop(of_id, of_hash, key), name


def _without(texts: pa.Array, at: pa.Array, size: pa.Array) -> pa.Array:
    parts = []
    for s in steps(iter([pa.RecordBatch.from_arrays([texts, at, size], ["text", "at", "size"])]), "text", STEP_BYTES):
        x, places = Lines.of(s.column("text")), s.column("at")
        covered = np.zeros(len(x.words) + 1, np.int64)
        flat_at, of = places.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(s)), np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        k = s.column("size")[0].as_py() if len(s) else 0
        np.add.at(covered, x.begin[of] + flat_at, 1)
        np.add.at(covered, x.begin[of] + flat_at + k, -1)
        gone = np.cumsum(covered)[:-1] > 0
        removed = np.append(0, np.cumsum(gone))[x.begin]
        removed = removed[1:] - removed[:-1]
        kept = s.column("text").to_pylist()
        for d in np.flatnonzero(removed).tolist():
            out, last = [], -1
            for i in (np.flatnonzero(~gone[x.begin[d] : x.begin[d + 1]]) + x.begin[d]).tolist():
                if out and x.of_line[i] != last:
                    out.append(b"\n")
                out.append(x.data[x.start[i] : x.end[i]].tobytes())
                last = x.of_line[i]
            kept[d] = b"".join(out).decode()
        parts.append(pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(np.diff(x.begin).astype(np.int32)), pa.array(removed.astype(np.int32))], ["text", "n_lines", "n_removed"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32())]))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name comes second): text without later occurrences, n_lines (that hold a word, long ones wrapped), n_removed."""
    out, at = marked(docs, id_col, text_col, size)
    name = free_name(out, "cleaned")
    without = F.arrow_udf(_without, "struct<text: string, n_lines: int, n_removed: int>").asNondeterministic()  # so that a filter on it does not run it twice
    return out.withColumn(name, without(F.col(f"`{text_col}`").cast("string"), F.col(at), F.lit(size))).drop(at), name


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """docs, with its columns: texts without later occurrences. Documents of which every line was one are dropped."""
    out, name = cleaned(docs, id_col, text_col, size)
    s = F.col(name)
    kept = out.filter((s["n_removed"] < s["n_lines"]) | (s["n_lines"] == 0))
    return kept.withColumn(text_col, s["text"]).drop(name).select(docs.columns)
