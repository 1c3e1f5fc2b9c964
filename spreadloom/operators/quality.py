"""Checks of bars and batches, dates for undated rows, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import in_window, trade_date


def sound(low: float, high: float) -> Column:
    """OHLC relations, volume not negative, close in [low, high]."""
    prices = F.col("close").between(low, high) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low"))
    return F.coalesce(prices & F.col("volume").isNotNull() & (F.col("volume") >= 0), F.lit(False))


def dated(rows: DataFrame, key: str, order: str, clock: str, base: Column) -> DataFrame:
    """`rows` with day: a date for times of day that stand newest first from `base` on. Each rise of the clock on the
    way back is a midnight."""
    w = Window.partitionBy(key).orderBy(order)
    crossed = F.when(F.col(clock) > F.lag(clock).over(w), 1).otherwise(0)
    out = rows.withColumn("c_", crossed).withColumn("n_", F.sum("c_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("day", F.date_sub(base, F.col("n_").cast("int"))).drop("c_", "n_")


def batches(rows: DataFrame, key: str, t: str, most_dates: int = 2) -> DataFrame:
    """key, n, dates, weekend, accepted: a batch is refused with weekend dates, too many dates or unreadable times."""
    day = trade_date(F.col(t))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(day).alias("dates"), F.bool_or(F.coalesce(F.weekday(day) >= 5, F.lit(False))).alias("weekend"), F.count_if(F.col(t).isNull()).alias("unreadable"))
    return out.select(key, "n", "dates", "weekend", (~F.col("weekend") & (F.col("dates") <= most_dates) & (F.col("unreadable") == 0)).alias("accepted"))


def freshness(bars: DataFrame, key: str, t: str, asof: DataFrame) -> DataFrame:
    """key, last_t, age in minutes at the only value of `asof` (column asof)."""
    last = bars.groupBy(key).agg(F.max(t).alias("last_t"))
    return last.join(F.broadcast(asof)).select(key, "last_t", F.timestamp_diff("MINUTE", F.col("last_t"), F.col("asof")).alias("age"))


def stale(ages: DataFrame, windows: DataFrame, minute: Column) -> DataFrame:
    """`ages` (instr, age) joined with trading windows (instr, opens, closes, tolerance) and state: closed, ok or stale."""
    out = ages.join(windows, "instr")
    state = F.when(~in_window(minute, F.col("opens"), F.col("closes")), "closed").when(F.col("age") > F.col("tolerance"), "stale").otherwise("ok")
    return out.withColumn("state", state)
