"""Scans along very long series, by blocks of time.

Each block of a series is worked through by itself and leaves a summary of one row; a window over the summaries of a
series says what every block starts from, and rows take that up where they lie. So no task holds more of a series than
a block, whatever its length; what meets in one place is a row per block. Times and keys are never null.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Minutes of a block, and values of a block of a sorted frame.
DAY, SORTED = 1440, 1024


def block(t: str, minutes: int = DAY) -> Column:
    """Number of the block of `minutes` (a part of a day) that a time lies in."""
    day = F.unix_date(F.to_date(t)).cast("long")
    if minutes >= DAY:
        return F.floor(day / (minutes // DAY))
    return day * (DAY // minutes) + F.floor((F.hour(t) * 60 + F.minute(t)) / minutes)


def local(keys: list[str], t: str) -> WindowSpec:
    return Window.partitionBy(*keys, "block_").orderBy(t)


def along(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("block_")


def upto(w: WindowSpec, last: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def numbered(df: DataFrame, keys: list[str], t: str, name: str, minutes: int = DAY) -> DataFrame:
    """`df` with the number of the row in its series, from 0."""
    rows = df.withColumn("block_", block(t, minutes))
    base = rows.groupBy(*keys, "block_").agg(F.count("*").alias("n_")).withColumn("base_", F.coalesce(F.sum("n_").over(upto(along(keys), -1)), F.lit(0)))
    rows = rows.withColumn(name, F.row_number().over(local(keys, t)))
    return rows.join(base.select(*keys, "block_", "base_"), [*keys, "block_"]).withColumn(name, F.col(name) + F.col("base_") - 1).select(*df.columns, name)


def before(df: DataFrame, keys: list[str], t: str, fields: list[str], name: str, minutes: int = DAY) -> DataFrame:
    """`df` with the row before as a struct of t and `fields`, null in the first; rows of one time come in the order of
    `fields`. A summary is the last row of a block, which is put before the rows of the next."""
    one = F.struct(t, *fields)
    rows = df.withColumn("block_", block(t, minutes)).withColumn("own_", F.lit(True))
    sums = rows.groupBy(*keys, "block_").agg(F.max(one).alias("last_")).withColumn("last_", F.lag("last_").over(along(keys))).where("last_ is not null")
    both = rows.unionByName(sums.select(*keys, "block_", "last_.*", F.lit(False).alias("own_")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "block_").orderBy(t, *fields)
    return both.withColumn(name, F.lag(one).over(w)).where("own_").select(*df.columns, name)


def sessionize(df: DataFrame, keys: list[str], t: str, gap: float, name: str = "sid", minutes: int = DAY) -> DataFrame:
    """`sessions.sessionize` by blocks: a summary is the first and last time of a block and how often a session starts in it."""
    from spreadloom.operators.sessions import after

    rows = df.withColumn("block_", block(t, minutes))
    w = local(keys, t)
    rows = rows.withColumn("starts_", F.when(F.col(t) > after(F.lag(t).over(w), gap), 1).otherwise(0))
    sums = rows.groupBy(*keys, "block_").agg(F.min(t).alias("first_"), F.max(t).alias("last_"), F.sum("starts_").alias("n_"))
    opens = F.when(F.col("first_") > after(F.lag("last_").over(along(keys)), gap), 1).otherwise(0)
    sums = sums.withColumn("opens_", opens).withColumn("base_", F.sum(F.col("n_") + F.col("opens_")).over(upto(along(keys))) - F.col("n_"))
    rows = rows.withColumn(name, F.sum("starts_").over(upto(w)))
    return rows.join(sums.select(*keys, "block_", "base_"), [*keys, "block_"]).withColumn(name, F.col(name) + F.col("base_")).select(*df.columns, name)


def drawdown(df: DataFrame, keys: list[str], t: str, x: str, minutes: int = DAY) -> DataFrame:
    """`stats.drawdown` by blocks: a summary is the sum of a block and its highest running sum."""
    rows = df.withColumn("block_", block(t, minutes))
    w = upto(local(keys, t))
    rows = rows.withColumn("total", F.sum(x).over(w)).withColumn("peak", F.max("total").over(w))
    sums = rows.groupBy(*keys, "block_").agg(F.sum(x).alias("sum_"), F.max("total").alias("top_"))
    before = upto(along(keys), -1)
    sums = sums.withColumn("base_", F.coalesce(F.sum("sum_").over(before), F.lit(0.0))).withColumn("high_", F.max(F.col("base_") + F.col("top_")).over(before))
    out = rows.join(sums.select(*keys, "block_", "base_", "high_"), [*keys, "block_"])
    out = out.withColumn("total", F.col("total") + F.col("base_")).withColumn("peak", F.greatest(F.col("peak") + F.col("base_"), "high_"))
    return out.withColumn("drawdown", F.col("total") - F.col("peak")).select(*df.columns, "total", "peak", "drawdown")


def held(df: DataFrame, keys: list[str], t: str, z: str, enter: float, leave: float, minutes: int = DAY) -> DataFrame:
    """`signals.held` (without crossings) by blocks.

    What a block makes of the position before it: where a score comes near the mean in it, the side of the first wide one
    after the last such; else the position before, or the side of its first wide score if that is none. So the position
    before a block is the first side since the last block with a score near the mean.
    """
    if not leave < enter:
        raise ValueError("leave lies below enter")
    rows = df.select(*keys, t, z, block(t, minutes).alias("block_"))
    rows = rows.withColumn("near_", F.sum(F.when(F.abs(z) <= leave, 1).otherwise(0)).over(upto(local(keys, t))))
    wide = F.when(F.abs(z) >= enter, -F.signum(z))
    side = F.first(wide, ignorenulls=True).over(upto(Window.partitionBy(*keys, "block_", "near_").orderBy(t)))
    rows = rows.withColumn("side_", side)
    sums = rows.groupBy(*keys, "block_").agg(F.max("near_").alias("nears_"), F.max_by("side_", F.struct("near_", t)).alias("out_"))
    sums = sums.withColumn("stretch_", F.sum(F.when(F.col("nears_") > 0, 1).otherwise(0)).over(upto(along(keys))))
    within = upto(Window.partitionBy(*keys, "stretch_").orderBy("block_"))
    sums = sums.withColumn("after_", F.first("out_", ignorenulls=True).over(within)).withColumn("before_", F.lag("after_").over(along(keys)))
    out = rows.join(sums.select(*keys, "block_", "before_"), [*keys, "block_"])
    pos = F.when(F.col("near_") == 0, F.coalesce("before_", "side_")).otherwise(F.col("side_"))
    return out.select(*keys, t, F.coalesce(pos, F.lit(0.0)).cast("int").alias("pos"))


def carried(left: DataFrame, right: DataFrame, keys: list[str], value: str, forward: bool = False, strict: bool = False, minutes: int = DAY) -> DataFrame:
    """As-of join: `left` (t, ...) with `value` and `value_t` of the last `right` row of its keys at or before t; with
    `forward` of the first at or after it. `strict` leaves out equal times. Rows without a match have nulls.

    `keys` are what both sides share, none for one series that all rows look up: it is not copied. Both sides are stacked
    in blocks of time, one window pass fills the value in within a block, and the last value of the blocks before comes to
    the rows of a block as one row.
    """
    rest = [c for c in left.columns if c not in (*keys, "t")]
    mine = left.select(*keys, "t", F.struct(*rest).alias("row_") if rest else F.struct(F.lit(1)).alias("row_"), F.lit(None).cast(dict(right.dtypes)[value]).alias("v_"), F.lit(True).alias("left_"))
    kind = dict(mine.dtypes)["row_"]
    theirs = right.select(*keys, "t", F.lit(None).cast(kind).alias("row_"), F.col(value).alias("v_"), F.lit(False).alias("left_"))
    # at equal times: backward the right row comes first, forward last; strict turns that around
    mine_at = int(strict == forward)
    rows = mine.unionByName(theirs).withColumn("block_", block("t", minutes)).withColumn("seen_", F.when(~F.col("left_"), F.struct("v_", F.col("t").alias("t_"))))
    # forward is backward in falling order: a frame that runs on to the end is gone through anew for each row
    turn = F.desc if forward else F.asc
    w = Window.partitionBy(*keys, "block_").orderBy(turn("t"), turn(F.when(F.col("left_"), mine_at).otherwise(1 - mine_at)))
    pick, most = (F.min_by, F.min) if forward else (F.max_by, F.max)
    found = F.when(F.col("seen_").isNotNull(), F.col("t"))
    # two plain values are aggregated by hash, a struct would be sorted for
    sums = rows.groupBy(*keys, "block_").agg(pick("v_", found).alias("v_"), most(found).alias("t_")).withColumn("own_", F.when(F.col("t_").isNotNull(), F.struct("v_", "t_")))
    near = F.last("seen_", ignorenulls=True).over(upto(w))
    far = F.last("own_", ignorenulls=True).over(upto(Window.partitionBy(*keys).orderBy(turn("block_")), -1))
    sums = sums.select(*keys, "block_", far.alias("far_"))
    out = rows.withColumn("near_", near).where("left_").join(sums, [*keys, "block_"], "left")
    got = F.coalesce("near_", "far_")
    return out.select(*keys, "t", *[F.col(f"row_.{c}").alias(c) for c in rest], got["v_"].alias(value), got["t_"].alias(f"{value}_t"))


class Sorted:
    """Values in order, in blocks of bounded length; the k-th is found by the lengths of the blocks."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        own = self.blocks[k]
        insort(own, x)
        self.tops[k] = own[-1]
        if len(own) > 2 * SORTED:
            self.blocks[k : k + 1] = [own[:SORTED], own[SORTED:]]
            self.tops[k : k + 1] = [own[SORTED - 1], own[-1]]

    def remove(self, x: float) -> None:
        self.size -= 1
        k = bisect_left(self.tops, x)
        own = self.blocks[k]
        del own[bisect_left(own, x)]
        if own:
            self.tops[k] = own[-1]
        else:
            del self.blocks[k], self.tops[k]

    def at(self, *places: int) -> list[float]:
        """Values at places (from 0) in rising order."""
        out, start, k = [], 0, 0
        for place in places:
            while place >= start + len(self.blocks[k]):
                start += len(self.blocks[k])
                k += 1
            out.append(self.blocks[k][place - start])
        return out


def rolling_quartiles(df: DataFrame, keys: list[str], t: str, x: str, rows: int, minutes: int = DAY) -> DataFrame:
    """`stats.rolling_quartiles` for long frames: r_med and r_iqr of the `rows` values before each, where all are there.

    A series is cut into stretches of `rows` rows by their numbers; each goes to one task with the stretch before it, and
    the values of the frame are kept in order as it moves, so a row costs the search in a sorted frame and no sort.
    """
    own = numbered(df.withColumn(x, F.col(x).cast("double")), keys, t, "n_", minutes)
    stretch = F.floor(F.col("n_") / rows)
    ahead = own.select(*df.columns, "n_", (stretch + 1).alias("stretch_"), F.lit(False).alias("own_"))
    both = own.select(*df.columns, "n_", stretch.alias("stretch_"), F.lit(True).alias("own_")).union(ahead)
    schema = StructType([*own.drop("n_").schema, StructField("r_med", DoubleType()), StructField("r_iqr", DoubleType())])

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_", ignore_index=True)
        values, mine = part[x].tolist(), part["own_"].tolist()
        frame, med, iqr, first = Sorted(), [], [], 0
        for k, (value, own_) in enumerate(zip(values, mine, strict=True)):
            while k - first > rows:
                if values[first] == values[first]:
                    frame.remove(values[first])
                first += 1
            if own_:
                q = frame.at(rows // 4, rows // 2, 3 * rows // 4) if frame.size == rows else None
                med.append(q[1] if q else None)
                iqr.append(q[2] - q[0] if q else None)
            if value == value:
                frame.add(value)
        out = part[part["own_"]].drop(columns=["n_", "stretch_", "own_"]).reset_index(drop=True)
        return out.assign(r_med=pd.Series(med, dtype="float64"), r_iqr=pd.Series(iqr, dtype="float64"))

    return both.groupBy(*keys, "stretch_").applyInPandas(slide, schema)
