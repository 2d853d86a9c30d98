"""Windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def previous_values(df: DataFrame, keys: list[str], order: list[str], values: list[str], period: str) -> DataFrame:
    """``lag(1)`` of ``values`` over ``order`` within ``keys``, as columns ``prev_<value>``.

    The history of a key is cut by the column ``period`` (it must not decrease along ``order``), so one window task
    sorts one period of one key. The last row of each period is handed on to the next period that has rows; a key has
    as many such rows as it has periods.
    """
    tail = df.groupBy(*keys, period).agg(
        F.max_by(F.struct(*order, *values), F.struct(*order)).alias("_tail")
    )
    by_key = Window.partitionBy(*keys).orderBy(period)
    handed_on = (
        tail.withColumn("_next", F.lead(period).over(by_key))
        .where(F.col("_next").isNotNull())
        .select(*keys, F.col("_next").alias(period), "_tail.*", F.lit(True).alias("_carried"))
    )
    cut = df.withColumn("_carried", F.lit(False)).unionByName(handed_on, allowMissingColumns=True)
    w = Window.partitionBy(*keys, period).orderBy(*order)
    for value in values:
        cut = cut.withColumn(f"prev_{value}", F.lag(value).over(w))
    return cut.where(~F.col("_carried")).drop("_carried")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank; limited inside each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def trailing_sums(df: DataFrame, keys: list[str], time: str, values: list[str], width: str, period: str) -> DataFrame:
    """Sums of the exact numbers ``values`` over a key's rows from ``width`` before a row up to its time, as ``sum_<value>``.

    Both ends count, so rows of one time have the same sums. Every row enters at its time and leaves behind ``width``; a
    running total of both is the sum, linear in the rows however many a frame holds. The history of a key is cut by
    ``period`` (month, day, ...), so one window task totals one period of one key; a period begins with what the ones
    before it leave, one row.
    """
    gone = F.expr(f"`{time}` + INTERVAL {width} + INTERVAL 1 MICROSECOND")
    leaving = df.select(*keys, gone.alias(time), *[(-F.col(v)).alias(v) for v in values], F.lit(False).alias("_own"))
    events = df.withColumn("_own", F.lit(True)).unionByName(leaving, allowMissingColumns=True)
    events = events.withColumn("_period", F.date_trunc(period, time))
    totals = events.groupBy(*keys, "_period").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    left = totals.select(*keys, "_period", F.col("_period").alias(time), *[F.sum(v).over(earlier).alias(v) for v in values], F.lit(False).alias("_own"))
    so_far = Window.partitionBy(*keys, "_period").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.unionByName(left, allowMissingColumns=True)
    summed = running.select("*", *[F.sum(v).over(so_far).alias(f"sum_{v}") for v in values])
    return summed.where("_own").drop("_own", "_period")
