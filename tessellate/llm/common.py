"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, shared_folder

#: Characters that end a word in the contracts on words: space, and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The tables that `cut` wrote, in order.
written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder, so that a lost executor costs no recomputation of what is above. (A checkpoint
    would take several times the disk, and carry on the plan's size estimates, which multiply in every join until their digits fill the driver.)"""
    written.append(scratch(df.sparkSession, "table"))
    df.write.parquet(written[-1])
    return df.sparkSession.read.schema(df.schema).parquet(written[-1])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no later step reads, and lets go of the shuffles behind them."""
    while paths:
        delete(spark, paths.pop())
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; of null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use (names are compared without case)."""
    return added_names(df, (base,))[0]


def added_names(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Names for columns that are added together: as wished, with underscores behind those that df has."""
    out: list[str] = []
    for name in names:
        taken = {c.lower() for c in (*df.columns, *out)}
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
