"""Benchmark decontamination by suffix arrays of the training texts.

Each step of a task is a shard: the word sequences of some documents. Its suffix array holds, in lexicographic order, the suffixes
that begin as some benchmark suffix does (their first words; no other can match). Every benchmark suffix is searched in it by bisection;
the suffixes that begin with its window are the places where the window occurs, and windows on one diagonal join to the longest
verbatim match. No shuffle; the benchmark travels to the tasks in blocks of bounded size, one pass for each block. Cases:

* null and empty texts: no words, no hits, not contaminated. Very long texts: whole; memory is bounded by one text.
* items of fewer words than a window are one window; items without words never occur. Items that share an id count as one; a null id counts as ''.
* ties: among equally long matches the least item id, then the first place. Repeated rows: judged alike. Empty tables: no rows, or no hits.
* extra columns and clashing names: carried; the one struct column that is added has a name the table does not use.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .hashing import ALPHANUMERIC, LOWER, STEP_BYTES, grams, words
from .tokens import flat, steps

#: One block of the benchmark has so many bytes of text at most.
BLOCK_BYTES = 8_000_000
#: Suffixes are sorted by so many words, or a window's if that is longer.
DEPTH = 32
TYPE = "struct<n_words: bigint, n_hit: bigint, items: array<string>, match_words: int, match_item: string, match_start: int, hits: binary>"
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("match_words", pa.int32()), ("match_item", pa.string()), ("match_start", pa.int32()), ("hits", pa.binary())])


@dataclass
class Block:
    """The suffixes of some items: the item's number, where in the item it starts and where among all words, words of its window, the hash of its first words; and all
    words as big-endian bytes, of which a window's key is cut when it is searched. About 50 bytes for a word."""

    ids: list[str]
    item: np.ndarray
    at: np.ndarray
    place: np.ndarray
    need: np.ndarray
    lead: int
    grams: np.ndarray
    big: bytes
    depth: int

    @staticmethod
    def of(items: list[tuple[str, str]], window: int) -> Block:
        ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(ids)}
        data, offsets, _ = flat(pa.array([t for _, t in items], pa.string()))
        hashes, _, _, begin = words(LOWER[data], offsets, ALPHANUMERIC)
        size = np.diff(begin)
        lead = int(min(4, window, size[size > 0].min(initial=4)))
        need = np.minimum(window, size)
        starts = np.where(size > 0, size - need + 1, 0)
        of = np.repeat(np.arange(len(items)), starts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
        place = begin[of] + at
        item = np.array([number[i] for i, _ in items], np.int64)[of] if len(items) else of
        return Block(ids, item, at, place, need[of], lead, grams(hashes, lead)[place], hashes.astype(">u8").tobytes(), max(DEPTH, window))

    def search(self, hashes: np.ndarray, begin: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard: place, item, the window's start in the item, its words. Marks the words that they cover in hit."""
        none = np.zeros((4, 0), np.int64)
        all_grams = grams(hashes, self.lead)
        if not len(self.grams) or not len(all_grams):
            return tuple(none)
        bits = np.zeros(1 << 18, bool)
        bits[self.grams & np.uint64(len(bits) - 1)] = True
        maybe = np.flatnonzero(bits[all_grams & np.uint64(len(bits) - 1)])
        maybe = maybe[np.isin(all_grams[maybe], self.grams)]
        stop = begin[np.searchsorted(begin, maybe, "right")]
        maybe, stop = maybe[maybe + self.lead <= stop], stop[maybe + self.lead <= stop]
        if not len(maybe):
            return tuple(none)
        big = hashes.astype(">u8").tobytes()
        suffixes = sorted((big[8 * p : 8 * min(p + self.depth, s)], p) for p, s in zip(maybe.tolist(), stop.tolist(), strict=True))
        keys, places = [k for k, _ in suffixes], np.array([p for _, p in suffixes])
        found = []
        for i in np.flatnonzero(np.isin(self.grams, all_grams[maybe])).tolist():
            key = self.big[8 * self.place[i] : 8 * (self.place[i] + self.need[i])]
            low = bisect_left(keys, key)
            high = bisect_right(keys, key + b"\xff" * 8 * self.depth, low)
            if high > low:
                at = places[low:high]
                found.append(np.stack([at, np.full(len(at), self.item[i]), np.full(len(at), self.at[i]), np.full(len(at), self.need[i])]))
        if not found:
            return tuple(none)
        place, item, at, need = np.concatenate(found, 1)
        edges = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edges, place, 1)
        np.add.at(edges, place + need, -1)
        hit |= np.cumsum(edges[:-1]) > 0
        return place, item, at, need


def _pass(block: Block, texts: pa.Array, earlier: pa.Array | None, keep_hits: bool) -> pa.Array:
    data, offsets, _ = flat(texts)
    hashes, _, _, begin = words(LOWER[data], offsets, ALPHANUMERIC)
    hit = np.zeros(len(hashes), bool)
    before = earlier.to_pylist() if earlier is not None else [None] * len(texts)
    for a, b, x in zip(begin[:-1].tolist(), begin[1:].tolist(), before, strict=True):
        if x and x["hits"]:
            hit[a:b] = np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=b - a).astype(bool)
    place, item, at, need = block.search(hashes, begin, hit)
    doc = np.searchsorted(begin, place, "right") - 1
    by_doc: dict[int, set[int]] = {}
    for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
        by_doc.setdefault(d, set()).add(i)
    best: dict[int, tuple] = {}
    if len(place):  # windows that follow one another on a diagonal of one item are one match
        order = np.lexsort((place, place - at, item, doc))
        p, i, o, n, d = place[order], item[order], at[order], need[order], doc[order]
        new = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(p - o) != 0) | (np.diff(i) != 0) | (np.diff(d) != 0)))
        run = np.diff(np.append(new, len(p)))
        for k, m in zip(new.tolist(), run.tolist(), strict=True):
            this = (-(int(n[k]) + m - 1), block.ids[i[k]], int(p[k] - begin[d[k]]))
            best[int(d[k])] = min(best.get(int(d[k]), this), this)
    n_hit = np.append(0, np.cumsum(hit))
    rows = []
    for d, (a, b, x) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), before, strict=True)):
        items = {block.ids[i] for i in by_doc.get(d, ())}
        match = best.get(d)
        if x:
            items |= set(x["items"])
            old = (-x["match_words"], x["match_item"], x["match_start"]) if x["match_words"] else None
            match = min(filter(None, (match, old)), default=None)
        rows.append({"n_words": b - a, "n_hit": int(n_hit[b] - n_hit[a]), "items": sorted(items), "match_words": -match[0] if match else 0, "match_item": match and match[1], "match_start": match and match[2], "hits": np.packbits(hit[a:b]).tobytes() if keep_hits else None})
    return pa.array(rows, ARROW)


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name comes second): n_words, n_hit, items, and the longest verbatim match (words, item, start)."""
    name = free_name(docs, "benchmark_hits")
    listed = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{item_text_col}`").alias("text")).filter("text is not null")
    blocks = max(1, -(-(listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for b in range(blocks):
        items = [(r["id"], r["text"]) for r in listed.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()]
        docs = _with_block(docs, Block.of(items, window), text_col, name, first=b == 0, keep_hits=blocks > 1)
    return docs, name


def _with_block(docs: DataFrame, block: Block, text_col: str, name: str, first: bool, keep_hits: bool) -> DataFrame:
    @F.arrow_udf(TYPE)
    def start(texts: pa.Array) -> pa.Array:
        parts = [_pass(block, s.column("text"), None, keep_hits) for s in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", STEP_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], ARROW)

    @F.arrow_udf(TYPE)
    def go_on(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        parts = [_pass(block, s.column("text"), s.column("earlier"), keep_hits) for s in steps(iter([pa.RecordBatch.from_arrays([texts, earlier], ["text", "earlier"])]), "text", STEP_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], ARROW)

    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumn(name, start(text) if first else go_on(text, F.col(name)))


def contaminated(s: Column) -> Column:
    """At least one word in twenty is hit."""
    return (s["n_hit"] > 0) & (20 * s["n_hit"] >= s["n_words"])


def items_sha256(s: Column) -> Column:
    return F.sha2(F.array_join(s["items"], ","), 256)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of docs, with its columns, that are not contaminated."""
    out, name = matched(docs, benchmark, text_col, **names)
    return out.filter(~contaminated(F.col(name))).drop(name)

