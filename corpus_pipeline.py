"""The corpus pipeline: documents through a list of stages, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents. A stage begins by removing the tables that earlier
ones left in the shared folder: what a stage returns must be written, as run does, before the next one is called. Cases:

* null and empty texts: quality rules reject them, as any text of fewer than 50 words. Very long texts: whole in every stage; line dedup may empty a
  text, whose document then goes. Empty table: every stage returns no rows.
* repeated rows: line dedup sees them as one document; the Jaccard join keeps one of them. Ties: as each operator says; null ids come last.
* extra columns and clashing names: carried up to packing, which returns its own columns; n_chars follows the text where there is such a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.llm import common, decontaminate, jaccard_join, line_dedup, packing, quality_rules
from tessellate.llm.common import read, scratch
from tessellate.llm.queries import tokenizer


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stages run so far have cut.
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """f, which first removes what earlier stages left, as its input is written."""

    @wraps(f)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _left)
        before = len(common.written)
        out = f(spark, docs, sf_dir)
        _left.extend(common.written[before:])
        return out

    return clean


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later occurrences of three-line windows go; n_chars follows the text."""
    clean = line_dedup.dedupe(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


@stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of linked ones stays."""
    return jaccard_join.keep_one(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: contaminated documents go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left, as sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]
#: Tokenizing and best-two-fit packing are not SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        apply(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
