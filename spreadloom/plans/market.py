"""Market frames derived from the given tables, and the same frames in SQL.

Event types play instruments: an event is a tick (price `value`, size the number in `props`). Order priorities are
daily instruments. Bar width, session gap and widest step are the same for every folder; other widths are a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.operators import align, bars, sessions


@dataclass(frozen=True)
class Scale:
    """Bar width, longest gap within a session and widest step between consecutive bars, all in minutes."""

    bar: int
    gap: int
    step: float


HOURLY = Scale(60, 120, 90)

# Point value, currency, rank and root of each stand-in instrument.
SPEC = [("click", 1000.0, "USD", 1, "ZN"), ("error", 2000.0, "USD", 2, "ZT"), ("purchase", 1.0, "KRW", 3, "FX"), ("signup", 1000000.0, "KRW", 4, "65"), ("view", 1000000.0, "KRW", 5, "67")]


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str, scale: Scale = HOURLY):
        self.spark, self.dir, self.scale = spark, sf_dir.rstrip("/"), scale

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        size = F.get_json_object("props", "$.k").cast("double")
        return self.table("events").where("value > 0").select(
            F.col("event_type").alias("instr"), F.col("ts").alias("t"), F.col("value").alias("px"), size.alias("qty"), "event_id")

    @cached_property
    def bars(self) -> DataFrame:
        return bars.tick_bars(self.ticks, f"{self.scale.bar} minutes")

    @cached_property
    def aligned(self) -> DataFrame:
        return align.pair_up(self.bars)

    @cached_property
    def pair_bars(self) -> DataFrame:
        return sessions.sessionize(self.aligned, ["pair"], "t", self.scale.gap)

    @cached_property
    def spread(self) -> DataFrame:
        return self.pair_bars.withColumn("s", F.col("a_close") - F.col("b_close"))

    @cached_property
    def steps(self) -> DataFrame:
        return sessions.consecutive(self.spread, ["pair", "sid"], "t", "s", self.scale.step)

    @cached_property
    def fx(self) -> DataFrame:
        return self.ticks.where("instr = 'purchase'").select("t", F.col("px").alias("rate"))

    @cached_property
    def spec(self) -> DataFrame:
        return self.spark.createDataFrame(SPEC, "instr string, point double, ccy string, rank int, root string")

    @cached_property
    def daily(self) -> DataFrame:
        """Daily closes of order priorities: the last order of the day by key."""
        return self.table("orders").groupBy(F.col("o_orderpriority").alias("instr"), F.to_date("o_orderdate").alias("d")).agg(
            F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Five-level books around each tick: prices in cents from it, sizes from the event number."""
        side = lambda sign: F.array(*[F.struct((F.col("value") + sign * i * 0.01).alias("px"), ((F.col("event_id") * i) % 97).cast("double").alias("qty")) for i in range(1, 6)])
        ask = F.array(*[F.struct((F.col("value") + i * 0.01).alias("px"), ((F.col("event_id") * (i + 6)) % 89).cast("double").alias("qty")) for i in range(1, 6)])
        return self.table("events").where("value > 1").select(F.col("event_type").alias("instr"), F.col("ts").alias("t"), side(-1).alias("bids"), ask.alias("asks"))

    @cached_property
    def log(self) -> DataFrame:
        """Times at which a collector is known to have run: every twentieth event of the error type."""
        return self.table("events").where("event_type = 'error' and event_id % 20 = 0").select("ts")


PARTS = {
    "ticks": "SELECT event_type AS instr, ts AS t, value AS px, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, event_id FROM events WHERE value > 0",
    "bars": "SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_min(px, t) AS open, max(px) AS high, min(px) AS low, arg_max(px, t) AS close, sum(qty) AS volume, count(*) AS n FROM ticks GROUP BY ALL",
    "aligned": "SELECT a.instr || '-' || b.instr AS pair, a.instr AS a, b.instr AS b, a.t, a.open AS a_open, a.close AS a_close, b.open AS b_open, b.close AS b_close FROM bars a JOIN bars b ON a.t = b.t AND a.instr < b.instr",
    "gaps": "SELECT *, lag(t) OVER (PARTITION BY pair ORDER BY t) AS before FROM aligned",
    "pair_bars": "SELECT * EXCLUDE (before), CAST(sum(CASE WHEN t > before + INTERVAL '120 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM gaps",
    "spread": "SELECT *, a_close - b_close AS s FROM pair_bars",
    "lagged": "SELECT pair, sid, t, s, lag(s) OVER w AS x, lag(t) OVER w AS t0 FROM spread WINDOW w AS (PARTITION BY pair, sid ORDER BY t)",
    "steps": "SELECT pair, sid, t, x, s, s - x AS d FROM lagged WHERE x IS NOT NULL AND t <= t0 + INTERVAL '90 minutes'",
    "fx": "SELECT t, px AS rate FROM ticks WHERE instr = 'purchase'",
    "spec": "SELECT instr, CAST(point AS DOUBLE) AS point, ccy, rank, root FROM (VALUES " + ", ".join(map(str, SPEC)) + ") v(instr, point, ccy, rank, root)",
    "daily": "SELECT o_orderpriority AS instr, CAST(o_orderdate AS DATE) AS d, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL",
    "quotes": "SELECT event_type AS instr, ts AS t, [{'px': value - i * 0.01, 'qty': CAST((event_id * i) % 97 AS DOUBLE)} FOR i IN [1, 2, 3, 4, 5]] AS bids, [{'px': value + i * 0.01, 'qty': CAST((event_id * (i + 6)) % 89 AS DOUBLE)} FOR i IN [1, 2, 3, 4, 5]] AS asks FROM events WHERE value > 1",
    "log": "SELECT ts FROM events WHERE event_type = 'error' AND event_id % 20 = 0",
}


def sql(body: str) -> str:
    """`body` behind the common parts that it names, directly or by others."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name, part in PARTS.items():
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                used.add(name)
                visit(part)

    visit(body)
    parts = [f"{name} AS ({part})" for name, part in PARTS.items() if name in used]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if parts and body.startswith(start):
            return start + ",\n".join(parts) + ",\n" + body.removeprefix(start)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


Build = Callable[[Market], DataFrame]


class Catalog:
    """Named queries over a market, with or without SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        self.builds: dict[str, Build] = {}

    def add(self, name: str, text: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            self.queries[name] = lambda spark, sf_dir: build(Market(spark, sf_dir))
            self.builds[name] = build
            if text:
                self.oracles[name] = sql(text)
            return build

        return keep
