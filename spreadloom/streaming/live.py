"""Structured Streaming twins of the batch frames: bars, counter sizes, rolling scores, sessions, last quotes, keyed sinks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from spreadloom.functions.columns import FLOOR
from spreadloom.sources.store import KeyedStore


def ticks_from(spark: SparkSession, folder: str, schema: str | StructType, files: int = 1) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def spoken(messages: DataFrame, schema: str, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """What messages of JSON text say, behind the columns of `keep` that came with them."""
    return messages.select(*keep, F.from_json(F.col(value), schema).alias("m_")).select(*keep, "m_.*")


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades (with price and time) and quotes (with a second bid level)."""
    trade = F.col("price").isNotNull() & F.col("chetime").isNotNull()
    return rows.where(trade), rows.where(~trade & F.col("bidho2").isNotNull())


def split_messages(messages: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Trades and quotes of one stream of JSON text."""
    return sides(spoken(messages, schema, value))


#: Messages of both markets: trades at home come with their time of day and size, those abroad with a date and a counter.
MARKETS = "futcode string, price string, chetime string, cvolume string, symbol string, curpr string, kordate string, kortm string, totq string"


def market_ticks(messages: DataFrame, value: str = "value", day: str = "day") -> DataFrame:
    """instr, t, px, qty, totq of the trades of two markets in one feed of JSON text; `day` is the day a message came on.

    Numbers and times are text: times lack leading zeros, and what cannot be read, or has no price above 0, is left out.
    Trades at home have qty, those abroad totq, the day's volume so far.
    """
    m = messages.select(F.from_json(value, MARKETS).alias("m"), day).select("m.*", day)
    stamp = lambda d, t: F.try_to_timestamp(F.concat(d, F.lpad(F.trim(t), 6, "0")), F.lit("yyyyMMddHHmmss"))
    number = lambda c: F.trim(c).try_cast("double")
    home = m.where("futcode is not null").select(
        F.trim("futcode").alias("instr"), stamp(F.date_format(day, "yyyyMMdd"), "chetime").alias("t"), number("price").alias("px"), number("cvolume").alias("qty"), F.lit(None).cast("double").alias("totq"))
    abroad = m.where("futcode is null and symbol is not null").select(
        F.trim("symbol").alias("instr"), stamp("kordate", "kortm").alias("t"), number("curpr").alias("px"), F.lit(None).cast("double").alias("qty"), number("totq").alias("totq"))
    return home.unionByName(abroad).where("t is not null and px > 0")


def bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Bars that close when the watermark passes them; later ticks are dropped rather than starting a bar anew."""
    return ticks.withWatermark("t", late).groupBy(F.window("t", width), "instr").agg(
        F.min_by("px", "t").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "t").alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("n")).select("instr", F.col("window.start").alias("t"), "open", "high", "low", "close", "volume", "n")


def activity(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of activity per instrument; a gap of `gap` or more starts a new one."""
    return ticks.withWatermark("t", late).groupBy(F.session_window("t", gap).alias("w"), "instr").agg(F.count("*").alias("n")).select("instr", F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")


def once(ticks: DataFrame, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return ticks.withWatermark("t", late).dropDuplicatesWithinWatermark(keys)


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time, once the watermark has passed them.

    Rows that came before their turn are held, and a timer at the first of them brings them up: what is held of a key is
    what lies within the watermark's delay, and one batch. A row not later than one already passed on is dropped, as is one
    that the watermark has passed. Subclasses say which `columns` they read and what becomes of a sorted frame.
    """

    columns: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, " + ", ".join(f"{c} {k}" for c, k in self.columns.items()))
        self.marks = handle.getValueState("marks", "done long, due long")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, watermark: int) -> int | None:
        """Called when nothing is held: a time (in microseconds) to be woken at again."""
        return None

    def _wake(self, done: int, due: int | None, at: int | None) -> None:
        """Move the timer of the key from `due` to `at`."""
        if due is not None and due != at:
            self.handle.deleteTimer(due // 1000 + 1)
        if at is not None and due != at:
            self.handle.registerTimer(at // 1000 + 1)
        self.marks.update((done, -1 if at is None else at))

    def _marks(self) -> tuple[int, int | None]:
        done, due = self.marks.get() if self.marks.exists() else (-(1 << 62), -1)
        return done, None if due == -1 else due

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, due = self._marks()
        first = due
        for part in rows:
            part = part.assign(t=part["t"].astype("datetime64[us]").astype("int64"))
            part = part[part["t"] > done]
            if len(part):
                self.held.appendList(list(part[["t", *self.columns]].itertuples(index=False, name=None)))
                first = int(part["t"].min()) if first is None else min(first, int(part["t"].min()))
        self._wake(done, due, first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        done, _ = self._marks()
        held = list(self.held.get()) if self.held.exists() else []
        ready = sorted(r for r in held if r[0] <= watermark)
        later = [r for r in held if r[0] > watermark]
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        if ready:
            frame = pd.DataFrame(ready, columns=["t", *self.columns])
            done = ready[-1][0]
            yield self.step(key, frame).assign(t=pd.to_datetime(frame["t"], unit="us"))
        # the timer that fired is gone
        self._wake(done, None, min(r[0] for r in later) if later else self.idle(watermark))

    def close(self) -> None:
        pass


class CounterSizes(InOrder):
    """Sizes from a running counter per instrument: its rise, the whole of it after a reset, 0 for the first tick."""

    columns = {"px": "double", "totq": "double"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "totq double")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        old = rows["totq"].shift(1)
        if self.last.exists():
            old.iloc[0] = self.last.get()[0]
        step = rows["totq"] - old
        self.last.update((float(rows["totq"].iloc[-1]),))
        return rows.assign(instr=key[0], qty=step.where(step >= 0, rows["totq"]).where(old.notna(), 0.0))[["instr", "t", "px", "qty"]]


class RollingScores(InOrder):
    """Mean, deviation and score of each value over the last `rows` of its session, itself included, from `least` on.

    A key's state is a ring of the session's last values. A step of more than `gap` minutes starts a new session, and a
    ring whose session the watermark has left behind is given up.
    """

    columns = {"x": "double"}

    def __init__(self, rows: int, least: int, gap: float):
        self.rows, self.least, self.gap = rows, least, int(gap * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "last array<double>, at long")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ring, at = self.ring.get() if self.ring.exists() else ([], None)
        ring, out = deque(ring, self.rows), []
        for t, x in zip(rows["t"].tolist(), rows["x"].tolist(), strict=True):
            if at is not None and t - at > self.gap:
                ring.clear()
            ring.append(x)
            at = t
            if len(ring) < self.least:
                out.append((len(ring), None, None, None))
                continue
            own = np.array(ring)
            mean, sd = float(own.mean()), float(own.std())
            out.append((len(ring), mean, sd, (x - mean) / sd if sd > FLOOR else None))
        self.ring.update((list(ring), at))
        return rows.assign(key=key[0]).join(pd.DataFrame(out, columns=["r_n", "r_mean", "r_sd", "r_z"]))[["key", "t", "x", "r_n", "r_mean", "r_sd", "r_z"]]

    def idle(self, watermark: int) -> int | None:
        if not self.ring.exists():
            return None
        due = self.ring.get()[1] + self.gap
        if due > watermark:
            return due
        self.ring.clear()
        return None


#: State with timers needs this provider in `spark.sql.streaming.stateStore.providerClass`.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counter_sizes(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of ticks (instr, t, px, totq) with qty from the counter, in the order of time whatever the order they come
    in, as far as they come at most `late`. Needs the provider `ROCKSDB`."""
    return ticks.withWatermark("t", late).groupBy("instr").transformWithStateInPandas(
        statefulProcessor=CounterSizes(), outputStructType="instr string, t timestamp, px double, qty double", outputMode="Append", timeMode="EventTime")


def rolling_scores(values: DataFrame, rows: int, least: int, gap: float, late: str = "1 hour") -> DataFrame:
    """Stream of values (key, t, x) with r_n, r_mean, r_sd, r_z of the last `rows` within sessions that `gap` minutes
    without a value end; null before `least`. Needs the provider `ROCKSDB`."""
    return values.withWatermark("t", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=RollingScores(rows, least, gap), outputStructType="key string, t timestamp, x double, r_n int, r_mean double, r_sd double, r_z double", outputMode="Append", timeMode="EventTime")


def keyed_sink(folder: str, keys: list[str], buckets: int = 64, writer: str = "stream", **policy: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """Batch writer that upserts into the keyed store under `folder`; a batch that is written again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, folder, keys, buckets, **policy).write(batch, number, writer)

    return write


def demultiplexed(
    messages: str, trades: Callable[[DataFrame, int], None], quotes: Callable[[DataFrame, int], None], keep: tuple[str, ...] = ()
) -> Callable[[DataFrame, int], None]:
    """Batch writer that splits a feed of JSON text of this schema and hands trades and quotes to a writer each, with the
    columns of `keep`. With keyed sinks a batch that broke off between the two is written again and lands once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = spoken(batch, messages, keep=keep).persist()
        try:
            for rows, each in zip(sides(batch), (trades, quotes), strict=True):
                each(rows, number)
        finally:
            batch.unpersist()

    return write


def run_available(df: DataFrame, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, name: str | None = None) -> None:
    """Work through what is there and stop."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("memory").queryName(name or "live")
    w.start().awaitTermination()


def run_periodic(df: DataFrame, checkpoint: str, every: str, each: Callable[[DataFrame, int], None], mode: str = "append", until: Callable[[], bool] | None = None) -> None:
    """A batch every `every`, until `until` says so; without it until all that is there is done."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each).start()
    try:
        query.processAllAvailable()
        while until is not None and not until():
            query.awaitTermination(1)
    finally:
        query.stop()
