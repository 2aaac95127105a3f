"""Budgeted allocation of the top share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import free_names, ranked


def top_share(df: DataFrame, rate: float | Column, order: list[Column], name: str = "granted", by: list[str] | None = None) -> DataFrame:
    """df with a 0/1 column: 1 for the first bround(rate * n) rows of each group in the order, which must be total (end it with an id). A rate may be a column
    that is constant within a group. Groups may be of any size: ranks are counted range by range."""
    if not isinstance(rate, Column) and not 0 <= rate <= 1:
        raise ValueError("the rate must be within 0..1")
    place, size = free_names(df, "place_in_group", "size_of_group")
    share = rate if isinstance(rate, Column) else F.lit(rate)
    return ranked(df, by or [], order, place, size).withColumn(name, (F.col(place) <= F.bround(F.col(size) * share)).cast("int")).drop(place, size)
