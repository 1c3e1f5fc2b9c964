"""Bars from ticks and bars from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str) -> DataFrame:
    """instr, t, open, high, low, close, volume, n from ticks (instr, t, px, qty); volume adds sizes."""
    return ticks.groupBy("instr", F.window("t", width).alias("w")).agg(
        F.min_by("px", "t").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "t").alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("n")).select("instr", F.col("w.start").alias("t"), "open", "high", "low", "close", "volume", "n")


def counter_sizes(ticks: DataFrame, counter: str) -> DataFrame:
    """Ticks with qty from a running counter: its rise, the whole counter after a reset, nothing for the first tick."""
    before = F.lag(counter).over(Window.partitionBy("instr").orderBy("t"))
    step = F.col(counter) - before
    return ticks.withColumn("qty", F.when(before.isNull(), 0.0).when(step < 0, F.col(counter)).otherwise(step).cast("double"))


def calendar_closes(daily: DataFrame, unit: str) -> DataFrame:
    """Last close and summed volume per instrument and week, month or quarter of daily bars (instr, d, close, volume)."""
    return daily.groupBy("instr", F.trunc("d", unit).alias("d")).agg(F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"))


def iso_week(daily: DataFrame) -> DataFrame:
    return daily.groupBy("instr", F.expr("extract(yearofweek from d)").alias("year"), F.expr("extract(week from d)").alias("week")).agg(F.max_by("close", "d").alias("close"))


def resampled(bars: DataFrame, minutes: int, hour_floor: bool = False) -> DataFrame:
    """First open and last close per bucket, counted from the epoch, or within the hour with `hour_floor`."""
    bucket = F.date_trunc("hour", "t").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.minute("t") / minutes) * minutes).cast("int")) if hour_floor else F.window("t", f"{minutes} minutes").start
    return bars.withColumn("bucket", bucket).groupBy("instr", "bucket").agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bucket", "t")


def spot_fallback(primary: DataFrame, spot: DataFrame) -> DataFrame:
    """Bars of `primary`, and for instruments without any a bar from `spot` (instr, t, px) with volume 0."""
    rest = spot.join(primary.select("instr").distinct(), "instr", "left_anti")
    one = rest.select("instr", "t", *[F.col("px").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))
    return primary.select("instr", "t", "open", "high", "low", "close", "volume").unionByName(one)
