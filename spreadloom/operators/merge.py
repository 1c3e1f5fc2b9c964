"""Keyed merges of immutable tables: what a store would do on a key conflict, as one full join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), largest: tuple[str, ...] = (), guard: tuple[str, ...] = ()) -> DataFrame:
    """All keys of both; on conflict columns take the new value, but `keep` the old one, `largest` the larger one and
    `guard` the new one only where it is not an empty string. Rows that repeat a key on a side count each."""
    rest = [x for x in old.columns if x not in keys]
    o = old.select(*keys, F.struct(*rest).alias("o"))
    n = new.select(*keys, F.struct(*rest).alias("n"))

    def pick(x: str) -> Column:
        a, b = F.col(f"o.{x}"), F.col(f"n.{x}")
        if x in keep:
            both = a
        elif x in largest:
            both = F.greatest(a, b)
        elif x in guard:
            both = F.coalesce(F.nullif(b, F.lit("")), a)
        else:
            both = b
        return F.when(F.col("o").isNull(), b).when(F.col("n").isNull(), a).otherwise(both).alias(x)

    return o.join(n, keys, "full").select(*keys, *[pick(x) for x in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def append_once(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """As `insert_absent`, the first of rows that repeat a key (by all columns) alone."""
    first = rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*rows.columns))).where("rn_ = 1").drop("rn_")
    return insert_absent(history, first, keys)


def within_second(quotes: DataFrame, keys: list[str], t: str, refreshed: list[str], first: list[str]) -> DataFrame:
    """One row per key and second: `refreshed` from its last snapshot, `first` from its first."""
    return quotes.groupBy(*keys, F.date_trunc("second", t).cast("timestamp_ntz").alias(t + "_")).agg(
        *[F.max_by(x, t).alias(x) for x in refreshed], *[F.min_by(x, t).alias(x) for x in first]).withColumnRenamed(t + "_", t)


def gap_state(old: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Gap table after an audit: known gaps keep first_seen and take the new extent, new ones come in, others stay."""
    o = old.select(*keys, F.struct("gap_to", "minutes", "first_seen", "last_seen").alias("o"))
    n = found.select(*keys, F.struct("gap_to", "minutes", "seen").alias("n"))
    return o.join(n, keys, "full").select(
        *keys, F.coalesce("n.gap_to", "o.gap_to").alias("gap_to"), F.coalesce("n.minutes", "o.minutes").alias("minutes"),
        F.coalesce("o.first_seen", "n.seen").alias("first_seen"), F.coalesce("n.seen", "o.last_seen").alias("last_seen"))


def close_gaps(gaps: DataFrame, bars: DataFrame, whole: bool, bar: int) -> DataFrame:
    """`gaps` (instr, gap_from, gap_to, minutes) with filled: any bar lies in the gap now, or with `whole` all do.

    Bars are counted per day first, so a gap meets at most the bars of its own days.
    """
    days = gaps.select("instr", "gap_from", "gap_to", "minutes", F.explode(F.sequence(F.to_date("gap_from"), F.to_date("gap_to"))).alias("day"))
    there = bars.select("instr", "t", F.to_date("t").alias("day"))
    met = days.join(there, ["instr", "day"], "left")
    inside = F.count_if(F.col("t").between(F.col("gap_from"), F.col("gap_to")))
    out = met.groupBy("instr", "gap_from", "gap_to", "minutes").agg(inside.alias("n"))
    filled = F.col("n") * bar >= F.col("minutes") if whole else F.col("n") > 0
    return out.select("instr", "gap_from", "gap_to", "minutes", filled.alias("filled"))
