"""As-of joins in one shuffle: both sides in one sorted run of each key, the last right row carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carry: list[str], tie: str, prefix: str = "r_") -> DataFrame:
    """Each left row with the columns right_time and `carry` of the last right row of its key whose time is not later.

    At equal times right rows come before left ones; among right rows of one time the one with the greatest `tie` is last. The union
    sorts once by (time, side, tie): rows of one key are streamed, nothing is paired and discarded."""
    kept = [right_time, *carry]
    row = left.select(F.col(key).alias("__key"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*kept)).schema[0].dataType).alias("__right"))
    other = right.select(F.col(key).alias("__key"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*kept).alias("__right"))
    w = Window.partitionBy("__key").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = row.unionByName(other).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select("__left.*", *[F.col("__found")[c].alias(prefix + c) for c in kept])


def within(joined: DataFrame, left_time: str, found_time: str, days: int, columns: list[str]) -> DataFrame:
    """An as-of join with a tolerance: columns are null where the row found is more than so many days old."""
    near = F.datediff(F.col(left_time), F.col(found_time)) <= days
    return joined.withColumns({c: F.when(near, F.col(c)) for c in columns})
