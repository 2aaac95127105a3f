"""Typed scans: CSV with a rename contract, JSON, files and their paths, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with its schema; what does not fit it fails. Columns are renamed to their meaning; `dates` (new names) are parsed to days."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).withColumnsRenamed(rename or {})
    return df.withColumns({c: F.to_date(c) for c in dates})


def month_start(month):
    """`YYYY-MM` to the first day of the month."""
    return F.to_date(F.concat(month, F.lit("-01")))


def clean_header(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Column names up to a bracket: `hiv test result (0/1)` is `hiv test result`."""
    return df.toDF(*[c.split(" (")[0].strip() for c in df.columns]).drop(*drop)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents, one a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, name, bytes, and what the path says of each: plan or shop, type and storeys."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower("path").rlike("/(atelier|shop)[^/]*/"), "shop").otherwise("plan")
    levels = F.regexp_extract_all(name, F.lit(r"NIV-?(\d+)(?:@(\d+))?"), 0)
    return f.select("path", name.alias("name"), "bytes", kind.alias("kind"), F.lower(F.regexp_extract(name, r"(?i)(colonne|dalle|mur|radier)", 1)).alias("type"), levels.alias("levels"))


@dataclass(frozen=True)
class Settings:
    """Every literal of an analysis; loaded from JSON, unknown keys are refused."""

    quantity_tolerance: int = 0
    length_tolerance: float = 0.02
    radius: float = 0.5

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        data = json.loads(Path(path).read_text())
        if unknown := set(data) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)
