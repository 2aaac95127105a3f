"""Sessions, and the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI mode; partitions: of a shuffle, before coalescing."""
    base = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


_to_remove: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This session's part of the checkpoint folder, which all executors share; it goes when the driver ends. Where no folder is set, a local session (as in
    tests) gets one of this machine, and a cluster an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessellate-"))
    path = context.getCheckpointDir()
    if path not in _to_remove:
        _to_remove.add(path)
        atexit.register(_remove, context._jvm, path)
    return path


def _remove(jvm: Any, path: str) -> None:
    """Also after the session's end, as long as the driver's JVM is there."""
    with contextlib.suppress(Exception):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that every later use sees the same rows and a lost executor costs no recomputation of what is above."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
