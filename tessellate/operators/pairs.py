"""Consecutive pairs of a unit's records, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def consecutive(df: DataFrame, unit: str, order: list[str], carry: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with the `carry` columns of its predecessor in the unit (null for the first): one window, one shuffle on the unit.

    `order` must be total within a unit: end it with an id."""
    before = F.lag(F.struct(*carry)).over(Window.partitionBy(unit).orderBy(*order))
    out = df.withColumn("__prev", before)
    return out.select("*", *[F.col("__prev")[c].alias(prefix + c) for c in carry]).drop("__prev")


def gap_years(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(YEAR_DAYS)


def annualised_growth_pct(value: Column, previous: Column, gap: Column) -> Column:
    """((value / previous) ** (1 / gap) - 1) * 100; null unless all three are positive."""
    fine = (value > 0) & (previous > 0) & (gap > 0)
    return F.when(fine, (F.pow(F.when(fine, value / previous), F.when(fine, F.lit(1.0) / gap)) - 1) * 100)


def pair_table(df: DataFrame, unit: str, time: str, ident: str, value: str, same: str, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """The pair table: gap, growth, one flag for each reason that makes a pair unusable, and is_valid: none of them."""
    p = consecutive(df, unit, [time, ident], [time, value, same])
    gap = gap_years(F.col(time), F.col(f"prev_{time}"))
    p = p.withColumn("gap", gap)
    p = p.withColumns({
        "no_previous": F.col(f"prev_{time}").isNull(),
        "bad_value": F.coalesce((F.col(value) <= 0) | (F.col(f"prev_{value}") <= 0), F.lit(False)),
        "bad_gap": F.coalesce((F.col("gap") <= low) | (F.col("gap") >= high), F.lit(False)),
    })
    p = p.withColumn("is_valid", ~(F.col("no_previous") | F.col("bad_value") | F.col("bad_gap")))
    growth = annualised_growth_pct(F.col(value), F.col(f"prev_{value}"), F.col("gap"))
    return p.withColumns({"growth": F.when(F.col("is_valid"), growth), "is_renewal": F.col(same).eqNullSafe(F.col(f"prev_{same}"))})
