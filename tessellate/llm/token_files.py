"""Token-id files with a shared zstandard dictionary.

The dictionary is trained on the serialized id arrays of a bounded, documented sample (about `sample` documents by the hash of their
id, 2 * sample at most, and at most `sample_chars` characters of each); it changes only the size of the files. Every document is compressed by itself, whole.
Documents are laid out in ascending id order: a file is a Parquet container of segments, each with its dictionary's hash, an index of
(id, tokens, place in the payload), its least and greatest id, and the payload of frames, so that one short document is read by its index entry alone. Cases:

* null text: empty, its end id alone. Null ids come first. Very long texts: one frame each, whole.
* repeated rows and ties: one frame each, ordered by the frame's checksum among equal ids. Empty table: no segments.
* extra columns and clashing names: only the id and the text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .packing import binary
from .tokens import encoder, steps

SEGMENT_BYTES = 4_000_000
#: The segments' first token numbers are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 500_000
SEGMENTS = "shard int, segment int, min_id long, max_id long, n_docs int, n_tokens long, id_width int, dict_hash string, doc_ids array<long>, tokens array<long>, ends array<long>, payload binary"


def train(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, sample: int = 2000, sample_chars: int = 4000, size: int = 64_000) -> bytes:
    """The dictionary, from a bounded sample; empty if there is too little to learn from."""
    ident, text = F.col(f"`{id_col}`"), F.substring(F.col(f"`{text_col}`").cast("string"), 1, sample_chars)
    part = sample / max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64(ident.cast("string")), F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30)))
    rows = docs.filter(drawn).select(text.alias("t")).filter("t is not null").limit(2 * sample).collect()
    enc = encoder(tokenizer_path)
    ids, begin = enc.encode(pa.array([r["t"] for r in rows], pa.string()))
    end = np.array([end_id], enc.type).tobytes()
    samples = [ids[a:b].tobytes() + end for a, b in zip(begin[:-1], begin[1:], strict=True)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 10 else b""
    except zstandard.ZstdError:  # too few or too small samples
        return b""


@functools.lru_cache(4)
def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True), zstandard.ZstdDecompressor(dict_data=shared)


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None) -> None:
    """Writes path/dictionary and path/segments."""
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer_path, id_col, text_col, end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (compressor, _) = encoder(tokenizer_path), _codec(dictionary)
        end = np.array([end_id], enc.type).tobytes()
        for batch in steps(batches, "text"):
            ids, begin = enc.encode(batch.column("text"))
            out = [compressor.compress(ids[a:b].tobytes() + end) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(begin) + 1), binary(out)], ["id", "n", "frame"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, width = TaskContext.get().partitionId(), 0, encoder(tokenizer_path).type.itemsize
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held)
            ends = np.cumsum(pc.binary_length(t["frame"]).to_numpy()).tolist()
            known = pc.min_max(t["id"]).as_py()
            row = {"shard": shard, "segment": number, "min_id": known["min"], "max_id": known["max"], "n_docs": len(t), "n_tokens": pc.sum(t["n"]).as_py(), "id_width": width, "dict_hash": dict_hash, "doc_ids": t["id"].to_pylist(), "tokens": t["n"].to_pylist(), "ends": ends, "payload": b"".join(t["frame"].to_pylist())}
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("id_width", pa.int32()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]))

        size = 0
        for batch in batches:
            for part in steps(iter([batch]), "frame", SEGMENT_BYTES):
                more = pc.sum(pc.binary_length(part.column("frame"))).as_py() or 0
                if held and size + more > SEGMENT_BYTES:
                    yield made()
                    size = 0
                held.append(part)
                size += more
        if held:
            yield made()

    compressed = cut(narrow.mapInArrow(frames, "id long, n long, frame binary"))
    order = [F.col("id"), F.crc32("frame")]
    ordered = compressed.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id_col, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    dictionaries = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sizes = rows.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_first"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.join(shards, "shard").select("shard", "segment", (F.col("shard_first") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first"))
    small = sizes.count() <= BROADCAST_ROWS

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                doc_ids, tokens, ends, payload, width, key, first = (batch.column(n)[row] for n in ("doc_ids", "tokens", "ends", "payload", "id_width", "dict_hash", "first"))
                n, ends = tokens.values.to_numpy(), ends.values.to_numpy()
                blob, kind, (_, reader) = payload.as_buffer(), np.dtype(f"<u{width.as_py()}"), _codec(dictionaries[key.as_py()])
                starts = np.append(0, ends[:-1])
                for at in range(0, len(n), 500):
                    out = [np.frombuffer(reader.decompress(blob[a:b]), kind).astype("<u4").tobytes() for a, b in zip(starts[at : at + 500].tolist(), ends[at : at + 500].tolist(), strict=True)]
                    if [len(x) // 4 for x in out] != n[at : at + 500].tolist():
                        raise ValueError("a frame does not hold as many ids as its index says")
                    before = first.as_py() + np.cumsum(n) - n
                    yield pa.RecordBatch.from_arrays([doc_ids.values[at : at + 500], pa.array(before[at : at + 500]), pa.array(n[at : at + 500]), binary(out)], ["id", "start", "n_tokens", "ids"])

    joined = rows.join(F.broadcast(firsts) if small else firsts, ["shard", "segment"])
    return joined.mapInArrow(documents, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids: the files are in order of id, so Parquet's statistics of min_id and max_id leave its segment's file alone, whose index entry
    says where its frame is. Of documents that share the id the first."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").filter((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
    place = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    entry = segments.select("shard", "segment", "dict_hash", "id_width", place.alias("place"), "ends").filter("place > 0").orderBy("shard", "segment").first()
    if entry is None:
        return None
    at, ends = entry["place"] - 1, entry["ends"]
    first = ends[at - 1] if at else 0
    frame = segments.filter((F.col("shard") == entry["shard"]) & (F.col("segment") == entry["segment"])).select(F.substring("payload", first + 1, ends[at] - first).alias("frame")).first()["frame"]
    dictionary = spark.read.parquet(f"{path}/dictionary").filter(F.col("dict_hash") == entry["dict_hash"]).first()["dictionary"]
    return np.frombuffer(_codec(bytes(dictionary))[1].decompress(bytes(frame)), f"<u{entry['id_width']}").tolist()
