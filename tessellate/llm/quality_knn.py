"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words' hashes, the shapes of its words, and what its length, repetition, line and symbol ratios amount to in steps. Term
frequencies, weighted by inverse document frequency, are projected on the leading singular vectors of the labelled sample (latent-semantic
analysis). The labelled vectors travel to the tasks; every document's cosines with all of them are computed exactly, a block at a time,
and its `neighbours` nearest vote with their similarity as weight. The sample is bounded by `sample` rows (those with the least hash of
their id), so what is broadcast is at most sample * dimensions numbers. Cases:

* null and empty texts: no words; they are scored by their length term as any other text. Very long texts: whole.
* ties in similarity: what the partial sort returns, by position in the sample, which is sorted by the id as text. Repeated rows: scored alike; of
  rows that share a labelled id the one with the least terms is learnt from, so that at most `sample` rows reach the driver.
* no usable labels: every score is 0.5. Labels with a null id or a null label are not used. Empty table: no rows.
* extra columns and clashing names: carried; the added column has a name the table does not use. Labels are read by their own names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .hashing import NOT_SPACE, STEP_BYTES, grams, words
from .tokens import flat, steps

BUCKETS, SHAPES, LEVELS = 1024, 64, 16
RATIOS = 5
TERMS = BUCKETS + SHAPES + RATIOS * LEVELS

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 8
_CLASS[[ord(c) for c in "#*$%&|<>=_~^"]], _CLASS[[ord(c) for c in "!?"]] = 16, 32


def terms(texts: pa.Array) -> np.ndarray:
    """Per text: relative term frequencies (their square roots), TERMS columns."""
    data, offsets, _ = flat(texts)
    hashes, start, end, begin = words(data, offsets, NOT_SPACE)
    n = np.diff(begin)
    out = np.zeros((len(n), TERMS), np.float32)
    doc = np.repeat(np.arange(len(n)), n)
    if len(hashes):
        shape = np.bitwise_or.reduceat(_CLASS[data], np.stack([start, np.minimum(end, len(data) - 1)], 1).ravel())[::2] if len(data) > 1 else _CLASS[data]
        counts = lambda of, size: np.bincount(doc * size + of, minlength=len(n) * size).reshape(len(n), size)
        out[:, :BUCKETS] = counts((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS)
        out[:, BUCKETS : BUCKETS + SHAPES] = counts(shape.astype(np.int64) & (SHAPES - 1), SHAPES)
    many = np.maximum(n, 1)
    out = np.sqrt(out / many[:, None])
    level = np.stack([np.log2(n + 1), *(15 * x for x in _ratios(hashes, begin, data, offsets, many))], 1)
    level = np.clip(np.rint(level), 0, LEVELS - 1).astype(np.int64) + np.arange(RATIOS) * LEVELS
    np.put_along_axis(out, BUCKETS + SHAPES + level, 1.0, 1)
    return out


def _ratios(hashes: np.ndarray, begin: np.ndarray, data: np.ndarray, offsets: np.ndarray, many: np.ndarray) -> Iterator[np.ndarray]:
    """Within [0, 1]: different words, different 3-word windows, bytes of symbols, bytes of capital letters."""
    for k in (1, 3):
        g = grams(hashes, k)
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[: len(g)]
        whole = np.arange(len(g)) + k <= begin[doc + 1]
        g, doc = g[whole], doc[whole]
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, bool)
        size = len(begin) - 1
        yield np.bincount(doc[new], minlength=size) / np.maximum(np.bincount(doc, minlength=size), 1)
    for bits in (16, 1):
        total = np.append(0, np.cumsum(_CLASS[data] & bits > 0))[offsets]
        yield np.minimum(np.diff(total) / many, 1)


@dataclass
class Model:
    """weight: inverse document frequencies; axes: TERMS x dimensions; vectors: the labelled rows, of length 1; labels: 0 or 1."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosine = self.project(terms(texts)) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 4
        return np.clip((vote * self.labels[near]).sum(1) / vote.sum(1), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = 4000, dimensions: int = 48, neighbours: int = 21) -> Model:
    """Learns from the `sample` labelled rows with the least hash of their id."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64(F.col("l_id").cast("string")), "l_id", "label").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            x = terms(batch.column("text")).astype(np.float16)
            row, col = np.nonzero(x)
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            take = lambda v, t: pa.array([v[a:b].astype(t).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), take(col, "<u2"), take(x[row, col], "<f2")], ["id", "label", "terms", "values"])

    learnt = rows.mapInArrow(found, "id string, label int, terms binary, values binary")
    one = learnt.groupBy("id", "label").agg(F.min(F.struct("terms", "values")).alias("of")).select("id", "label", "of.*")  # of rows that share an id one
    got = sorted(one.collect(), key=lambda r: (r["id"], r["label"]))
    x = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["values"], "<f2")
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.5).astype(np.float32)
    w = x * weight
    _, axes = np.linalg.eigh((w.T @ w).astype(np.float64))
    model = Model(weight, axes[:, ::-1][:, :dimensions].astype(np.float32), np.zeros((0, dimensions), np.float32), np.array([r["label"] for r in got], np.float64), neighbours)
    model.vectors = model.project(x)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one double column more (its name comes second), 0 to 1: higher, label 1 likelier."""
    name = free_name(docs, "quality_score")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(s.column("text")) for s in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", STEP_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score(F.col(f"`{text_col}`").cast("string"))), name


def held_out(ident: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(True))
