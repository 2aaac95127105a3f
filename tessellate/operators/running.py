"""Running sums and ranks of groups of any size: no task holds a group.

Where the largest group, counted first, has up to `ONE_SORT` rows, plain windows and aggregates do. Larger groups are cut into ranges of (group, order), which are
written once so that every later use sees the same ranges; sums are counted within each, and what the ranges before it hold is added from a table with one row
for each range of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows that one task sorts without thought.
ONE_SORT = 1_000_000
#: Rows of the ranges' table that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helping columns that df does not use."""
    out: list[str] = []
    for name in names:
        while name.lower() in {c.lower() for c in (*df.columns, *out)}:
            name += "_"
        out.append(name)
    return out


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group (of all, where by is empty)."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column | str], totals: dict[str, str] | None = None) -> DataFrame:
    """df with, for each name of `sums`, the sum of its values over the rows of the group up to this one; and for each name of `totals`, the whole sum
    of the named running sum. `order` must be total within a group."""
    totals, one = totals or {}, F.lit(0)
    fixed = cut(df)
    if largest_group(fixed, by) <= ONE_SORT:
        group = Window.partitionBy(*(by or [one]))
        upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        value = {n: F.col(s) if isinstance(s, str) else s for n, s in sums.items()}
        return fixed.select("*", *[F.sum(v).over(upto).alias(n) for n, v in value.items()], *[F.sum(value[of]).over(group).alias(n) for n, of in totals.items()])
    part, *groups = free_names(fixed, "range_of_row", *[f"group_{i}" for i in range(len(by))])
    before = {n: f"{n}_before_range" for n in sums}
    ranged = cut(fixed.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    value = {n: F.col(s) if isinstance(s, str) else s for n, s in sums.items()}
    sizes = ranged.groupBy(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], F.col(part).alias(f"{part}_of")).agg(*[F.sum(v).alias(n) for n, v in value.items()])
    group = Window.partitionBy(*(groups or [one]))
    earlier = group.orderBy(f"{part}_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select(*groups, f"{part}_of", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before[n]) for n in sums], *[F.sum(of).over(group).alias(n) for n, of in totals.items()]))
    within = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(v).over(within).alias(n) for n, v in value.items()])
    same = F.col(part) == F.col(f"{part}_of")
    for b, g in zip(by, groups, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(g))
    joined = local.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, same)
    return joined.withColumns({n: F.col(n) + F.col(before[n]) for n in sums}).drop(part, f"{part}_of", *groups, *before.values())


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """df with each row's place in the order of its group (from 1), and the group's size. `order` must be total."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, {total: name} if total else None)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the exact percentile at its share, between neighbours as far as the share asks for. Nulls take no part; a group without
    values has no row (null where there are no groups). In large groups equal values are counted first."""
    some = df.filter(F.col(value).isNotNull())
    if largest_group(some, by) <= ONE_SORT:
        return some.groupBy(*by).agg(*[F.percentile(value, F.lit(float(p))).alias(n) for n, p in shares.items()])
    counts = some.groupBy(*by, F.col(value).cast("double").alias("percentile_of")).agg(F.count("*").alias("n"))
    runs = running(counts, by, [F.col("percentile_of")], {"upto": "n"}, {"n_all": "upto"})
    place = lambda p: (F.col("n_all") - 1) * F.lit(float(p))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("percentile_of")))
    found = runs.groupBy(*by).agg(F.max("n_all").alias("n_all"), *[first(turn(place(p))).alias(f"{n}_{side}") for n, p in shares.items() for side, turn in (("low", F.floor), ("high", F.ceil))])
    part = lambda p: place(p) - F.floor(place(p))
    return found.select(*by, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part(p)).alias(n) for n, p in shares.items()])


def with_percentiles(stats: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """stats (one row a group of by) with the percentiles of df's value in its group, null where it has none."""
    found = percentiles(df, by, value, shares)
    if not by:
        return stats.crossJoin(F.broadcast(found))
    names = free_names(stats, *[f"of_{b}" for b in by])
    same = F.lit(True)
    for b, n in zip(by, names, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(n))
    return stats.join(found.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], *shares), same, "left").drop(*names)
