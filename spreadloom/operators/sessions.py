"""Sessions, steps within them, holes and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(t: Column, minutes: float) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 60.0))


def sessionize(df: DataFrame, keys: list[str], t: str, gap: float, name: str = "sid") -> DataFrame:
    """`df` with a session number per key: a step of more than `gap` minutes starts a new session."""
    w = Window.partitionBy(*keys).orderBy(t)
    starts = F.when(F.col(t) > after(F.lag(t).over(w), gap), 1).otherwise(0)
    return df.withColumn("starts_", starts).withColumn(name, F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_")


def consecutive(df: DataFrame, keys: list[str], t: str, value: str, widest: float) -> DataFrame:
    """Steps between neighbours of one session at most `widest` minutes apart: keys, t, x (before), value, d (change)."""
    w = Window.partitionBy(*keys).orderBy(t)
    out = df.select(*keys, t, value, F.lag(value).over(w).alias("x"), F.lag(t).over(w).alias("t0"))
    return out.where(F.col("x").isNotNull() & (F.col(t) <= after(F.col("t0"), widest))).select(*keys, t, "x", value, (F.col(value) - F.col("x")).alias("d"))


def session_table(df: DataFrame, key: str, t: str = "t", sid: str = "sid") -> DataFrame:
    """key, sid, n, first, last, rank (by length, the earlier first)."""
    out = df.groupBy(key, sid).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), sid)))


def longest(df: DataFrame, key: str, t: str = "t", sid: str = "sid") -> DataFrame:
    """Rows of the longest session of each key."""
    best = session_table(df, key, t, sid).where("rank = 1").select(key, sid)
    return df.join(best, [key, sid], "left_semi")


def holes(df: DataFrame, keys: list[str], t: str, bar: int) -> DataFrame:
    """Missing bars between neighbours of a session: keys, gap_from, gap_to, minutes."""
    w = Window.partitionBy(*keys).orderBy(t)
    out = df.select(*keys, t, F.lag(t).over(w).alias("t0"))
    apart = F.timestamp_diff("MINUTE", F.col("t0"), F.col(t))
    return out.where(apart > bar).select(*keys, after(F.col("t0"), bar).alias("gap_from"), after(F.col(t), -bar).alias("gap_to"), (apart - bar).alias("minutes"))


def merged(stamps: DataFrame, t: str, reach: float, keys: list[str] | None = None) -> DataFrame:
    """Intervals of `reach` minutes around each stamp, overlapping ones merged: keys, lo, hi.

    Without keys stamps are first merged within days, so that only the few intervals of a day meet in one task.
    """
    parts = keys or []
    spans = stamps.select(*parts, after(F.col(t), -reach).alias("lo"), after(F.col(t), reach).alias("hi"))
    by_day = fused(spans.withColumn("day_", F.to_date("lo")), [*parts, "day_"]).drop("day_")
    return fused(by_day, parts)


def fused(spans: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = spans.withColumn("new_", F.when(F.col("lo") <= reached, 0).otherwise(1))
    out = out.withColumn("island_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "island_").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island_")


def inside(spans: DataFrame, windows: DataFrame, lo: str, hi: str) -> DataFrame:
    """`spans` with covered: whether one of the (disjoint) windows (lo, hi) holds the span wholly.

    The window that a span can lie in is the last that begins at or before it, found by day buckets: a window is
    listed on each day that it touches, so no span meets windows of other days.
    """
    days = windows.select(F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"), F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("w_day"))
    within = (F.to_date(F.col(lo)) == F.col("w_day")) & (F.col(lo) >= F.col("w_lo")) & (F.col(hi) <= F.col("w_hi"))
    met = spans.join(days, within, "left")
    return met.groupBy(*spans.columns).agg(F.coalesce(F.bool_or(F.col("w_day").isNotNull()), F.lit(False)).alias("covered"))
