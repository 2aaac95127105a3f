"""Streaming versions of the state operators: file sources, watermarks, keyed state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import new_rows


def event_time(df: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Event time with a watermark; a time without zone is taken as of the session's zone (a watermark refuses it as it is)."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def unique(df: DataFrame, key: str, time: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def tumbling_counts(df: DataFrame, time: str, width: str, by: list[str]) -> DataFrame:
    return df.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    return df.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def transitions(df: DataFrame, record: str, state: str, order: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """Keyed state: each step (record, src, dst, legal) of a stream, in order within a batch. An illegal step changes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        rows = []
        for pdf in batches:
            for dst in pdf.sort_values(order)[state]:
                ok = now is None or (now, dst) in allowed
                rows.append((key[0], now, dst, ok))
                now = dst if ok else now
        held.update((now,))
        yield pd.DataFrame(rows, columns=[record, "src", "dst", "legal"])

    kind = df.schema[record].dataType.simpleString()
    return df.groupBy(record).applyInPandasWithState(step, f"{record} {kind}, src string, dst string, legal boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def upsert_into(df: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, into a Parquet folder, each key once: a replayed batch finds its keys and adds nothing. Of what is there only the keys are read; a folder that
    cannot be read stops the stream, and only one that is not there is taken as empty."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        known = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
        new_rows(batch, known, key).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, written and waited for."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
