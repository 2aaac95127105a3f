"""Index numbers and decompositions that close exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shift_share(both: DataFrame, year: str, n: str, mean: str, n_prev: str, mean_prev: str) -> DataFrame:
    """The change of a mean between two years, by year: within segments (old shares), mix of segments (new means), and their sum.

    `both` has the segments of either year, 0 rows and a null mean where a segment is absent; absent means count as 0 on their empty share."""
    N, P = F.col(n), F.col(n_prev)
    m, p = F.coalesce(F.col(mean), F.lit(0.0)), F.coalesce(F.col(mean_prev), F.lit(0.0))
    stay = (N > 0) & (P > 0)
    t = both.groupBy(year).agg(F.sum(N).alias("__n"), F.sum(P).alias("__p"))
    j = both.join(t, year).withColumns({"__s": F.try_divide(N, F.col("__n")), "__sp": F.try_divide(P, F.col("__p"))})
    s, sp = F.col("__s"), F.col("__sp")
    return j.groupBy(year).agg(
        F.sum(F.when(stay, sp * (m - p)).otherwise(0.0)).alias("within"),
        F.sum(F.when(stay, (s - sp) * m).otherwise(0.0)).alias("mix"),
        F.sum(F.when(~stay, s * m - sp * p).otherwise(0.0)).alias("entry"),
        F.sum(s * m - sp * p).alias("change"),
    )


def laspeyres(price: Column, base_price: Column, base_quantity: Column) -> Column:
    return F.sum(price * base_quantity) / F.sum(base_price * base_quantity)


def paasche(price: Column, quantity: Column, base_price: Column) -> Column:
    return F.sum(price * quantity) / F.sum(base_price * quantity)


def midpoint_change(a: Column, b: Column, a0: Column, b0: Column) -> tuple[Column, Column]:
    """Of the change of a product: what a's change and b's change make, each at the other's midpoint; they add up to the change."""
    return (a - a0) * (b + b0) / 2, (b - b0) * (a + a0) / 2
