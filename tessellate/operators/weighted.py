"""Weighted statistics, exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def weighted_percentiles(df: DataFrame, value: str, weight: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by, and for each name the left-continuous inverse of the weighted distribution: the first value at which the running weight reaches so many percent of the whole.

    Rows without weight take no part. Negative weights, NaN, and shares outside 0..100 raise an error; a group without mass has no row (null where there are no groups). Equal
    values are summed first, and all shares are read from one running sum."""
    if not all(0 <= p <= 100 for p in shares.values()):
        raise ValueError("a share must be within 0..100")
    bad = F.isnan(F.col(value).cast("double")) | F.isnan(F.col(weight).cast("double")) | (F.col(weight) < 0) | F.col(value).isNull() | F.col(weight).isNull()
    checked = df.withColumn(weight, F.when(bad, F.raise_error(F.lit("a weighted percentile needs numbers and weights of at least 0"))).otherwise(F.col(weight).cast("double")))
    mass = checked.filter(F.col(weight) > 0).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    runs = running(mass, by, [F.col(value)], {"__run": "__w"}, {"__all": "__run"})
    return runs.groupBy(*by).agg(*[F.min(F.when(F.col("__run") >= F.col("__all") * (p / 100), F.col(value))).alias(n) for n, p in shares.items()])


def weighted_percentile(df: DataFrame, value: str, weight: str, p: float, by: list[str], name: str = "percentile") -> DataFrame:
    return weighted_percentiles(df, value, weight, {name: p}, by)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of its parts: the same for the same parts, on any partitioning and engine."""
    text = F.concat_ws("~", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
