"""Joins of series by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.operators.scans import carried


def pair_up(bars: DataFrame) -> DataFrame:
    """All pairs of instruments on common times: pair, a, b, t, opens and closes of both; a sorts before b.

    Equal times meet, so the work per time grows with the square of the instruments, not of the bars.
    """
    a = bars.select(F.col("instr").alias("a"), "t", F.col("open").alias("a_open"), F.col("close").alias("a_close"))
    b = bars.select(F.col("instr").alias("b"), "t", F.col("open").alias("b_open"), F.col("close").alias("b_close"))
    both = a.join(b, "t").where("a < b")
    return both.select(F.concat_ws("-", "a", "b").alias("pair"), "a", "b", "t", "a_open", "a_close", "b_open", "b_close")


def enough(pairs: DataFrame, least: int) -> DataFrame:
    """pair, n of pairs with `least` common times."""
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def last_seen(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`left` with `value` of the `right` row at exactly t, else the last such value on an earlier left row of the keys."""
    both = left.join(right, "t", "left")
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w))


def on_grid(bars: DataFrame, names: list[str], last: int) -> DataFrame:
    """t and one close per name on the union of their times, the latest `last` of them; null where a name has no bar."""
    some = bars.where(F.col("instr").isin(names))
    wide = some.groupBy("t").pivot("instr", names).agg(F.first("close"))
    return wide.orderBy(F.desc("t")).limit(last)


def pivoted(bars: DataFrame, names: list[str]) -> DataFrame:
    """Wide mean closes, only times on which every name has a bar."""
    return bars.groupBy("t").pivot("instr", names).agg(F.avg("close")).dropna()


def later_sum(df: DataFrame, events: DataFrame, keys: list[str], t: str, at: str, value: str, inclusive: bool = False) -> DataFrame:
    """`df` with the sum of `value` over events after t (at or after it with `inclusive`), 0 without any."""
    total = events.groupBy(*keys).agg(F.sum(value).alias("all_"))
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    sums = events.select(*keys, F.col(at).alias("t"), F.sum(value).over(w).alias("done_")).distinct()
    out = carried(df.withColumnRenamed(t, "t"), sums, keys, "done_", strict=inclusive)
    out = out.join(total, keys, "left")
    return out.withColumn("later", F.coalesce(F.col("all_"), F.lit(0.0)) - F.coalesce(F.col("done_"), F.lit(0.0))).drop("all_", "done_", "done__t").withColumnRenamed("t", t)


def apart(column: Column, other: Column) -> Column:
    return F.abs(column - other)
