"""Guarded, idempotent and atomic writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def write_predictions(df: DataFrame, path: str, ident: str, granted: str, budget: int) -> None:
    """A CSV of unique ids and exactly `budget` grants, or an error before anything is written."""
    c = df.agg(F.count("*").alias("n"), F.count_distinct(ident).alias("ids"), F.sum(granted).alias("granted")).first()
    if c["n"] != c["ids"]:
        raise ValueError("ids are not unique")
    if (c["granted"] or 0) != budget:
        raise ValueError(f"{c['granted']} grants, not {budget}")
    df.select(ident, granted).write.option("header", True).mode("overwrite").csv(path)


def write_aggregate(df: DataFrame, path: str, forbidden: tuple[str, ...], count: str, least: int = 5) -> None:
    """An aggregate without forbidden columns and without a cell of 1 to least - 1."""
    if bad := set(map(str.lower, df.columns)) & set(map(str.lower, forbidden)):
        raise ValueError(f"not to be published: {sorted(bad)}")
    if df.filter((F.col(count) > 0) & (F.col(count) < least)).limit(1).count():
        raise ValueError(f"a cell has fewer than {least}")
    df.write.option("header", True).mode("overwrite").csv(path)


def as_answer(df: DataFrame) -> DataFrame:
    """One row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("answer"))


def nested(df: DataFrame, key: str, columns: list[str], name: str = "items") -> DataFrame:
    """One row a key with its rows as an array, sorted by its first column."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def write_findings(df: DataFrame, path: str) -> None:
    """Semicolons between values; the mark that some spreadsheets want stands before the first column's name, in every part: as many files as df has partitions."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).write.option("header", True).option("sep", ";").mode("overwrite").csv(path)


def new_rows(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The batch's rows whose key is not there yet, once each: an anti-join, so that a repeated delivery has no effect."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, through the session's file access."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def publish(df: DataFrame, path: str) -> str:
    """A new version beside the older ones, then the pointer file turned to it: a reader sees the old version or the new one, and a crash at any place
    leaves the old one. Returns the version's folder."""
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    new = at(f"{path}/.{name}")
    write_bytes(spark, f"{path}/.{name}", name.encode())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, at(f"{path}/CURRENT"), options)
    return f"{path}/{name}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    name = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/{name}")


def sealed(payload: Column, key: bytes) -> Column:
    """Encrypted at rest (AES, GCM); the key comes from outside."""
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"))


def opened(payload: Column, key: bytes) -> Column:
    return F.aes_decrypt(payload, F.lit(key), F.lit("GCM")).cast("string")
