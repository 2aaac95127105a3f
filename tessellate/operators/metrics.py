"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """The expected calibration error over equal bins, one row: partial counts by bin, then a sum over at most `bins` rows."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """The area under the curve by mid-ranks: ties get their mean rank. Equal scores are counted first, so the running sum has a row for each score."""
    per = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    r = running(per, by, [F.col(score)], {"upto": "n"}).withColumn("mid", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    return r.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"), F.sum(F.col("mid") * F.col("pos")).alias("ranks")).withColumn("auc", F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * (F.col("n_all") - F.col("n_pos"))))


def binary_metrics(label: Column, score: Column, cut: float = 0.5) -> dict[str, Column]:
    said = (score >= cut).cast("int")
    p = F.least(F.greatest(score, F.lit(1e-9)), F.lit(1 - 1e-9))
    hit = lambda a, b: F.sum(F.when((label == a) & (said == b), 1).otherwise(0))
    f1 = lambda a: F.coalesce(F.try_divide(2.0 * hit(a, a), 2 * hit(a, a) + hit(1 - a, a) + hit(a, 1 - a)), F.lit(0.0))
    return {"accuracy": F.avg((label == said).cast("double")), "macro_f1": (f1(0) + f1(1)) / 2, "log_loss": -F.avg(label * F.ln(p) + (1 - label) * F.ln(1 - p)), "brier": F.avg(F.pow(score - label, 2))}


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def indicator(numerator: Column, known: Column, least: int = 5) -> dict[str, Column]:
    """Numerator, denominator and missing, with counts of 1 to least - 1 withheld: missing is not negative, and a small cell is not published."""
    num, den = F.count_if(F.coalesce(numerator & known, F.lit(False))), F.count_if(known)
    small = lambda n: (n > 0) & (n < least)
    return {"numerator": F.when(~small(num), num), "denominator": F.when(~small(den), den), "missing": F.count_if(~known), "withheld": small(num) | small(den)}
