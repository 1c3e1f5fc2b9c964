"""The daily chain: collect, econ, health, rates, backfill, readiness; each stage writes a keyed store.

A store's manifest says how far a stage has come, so it is the chain's memory: a day that broke off after any stage goes
on with the next, and a day that is run again adds nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions.columns import zscore
from spreadloom.operators import align
from spreadloom.plans.market import Market
from spreadloom.sources.store import KeyedStore


class Chain:
    """Days are run in order. `least` is the sample that readiness asks for."""

    STAGES = ("collect", "econ", "health", "rates", "backfill", "readiness")
    KEYS = {"collect": ["instr", "t"], "backfill": ["instr", "t"], "econ": ["day", "pair"], "health": ["day", "instr"], "rates": ["t"], "readiness": ["day", "pair"]}

    def __init__(self, market: Market, folder: str, least: int = 20):
        self.m, self.folder, self.least = market, folder, least

    def store(self, stage: str) -> KeyedStore:
        # collect and backfill write one table of bars; a bar that is there already is not backfilled over
        name = "bars" if stage in ("collect", "backfill") else stage
        return KeyedStore(self.m.spark, f"{self.folder}/{name}", self.KEYS[stage], 8)

    def stage(self, stage: str, day: dt.date) -> DataFrame:
        """The rows that a stage writes for a day."""
        today, asof = F.to_date("t") == F.lit(day), F.lit(day)
        if stage == "collect":
            # what the first pass gets: it misses one hour in five
            return self.m.bars.where(today & (F.hour("t") % 5 != 4)).select("instr", "t", "close")
        if stage == "rates":
            return self.m.fx.where(today)
        bars = self.store("collect").read()
        if stage == "backfill":
            whole = self.m.bars.where(today).select("instr", "t", "close")
            return whole.join(bars.select("instr", "t"), ["instr", "t"], "left_anti")
        if stage == "health":
            found = bars.where(today).groupBy("instr").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
            return found.select(asof.alias("day"), "instr", "n", (24 - F.col("n")).alias("missing"), "first", "last")
        upto = bars.where(F.to_date("t") <= asof).withColumn("open", F.col("close"))
        pairs = align.pair_up(upto).withColumn("s", F.col("a_close") - F.col("b_close"))
        if stage == "econ":
            out = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.max_by("s", "t").alias("last"), zscore(F.max_by("s", "t"), F.avg("s"), F.stddev_pop("s")).alias("z"))
            return out.select(asof.alias("day"), "pair", "n", F.round("last", 6).alias("last"), F.round("z", 5).alias("z"))
        rated = pairs.join(self.store("rates").read().select("t").withColumn("hour", F.date_trunc("hour", "t").cast("timestamp_ntz")).select(F.col("hour").alias("t")).distinct(), "t", "left_semi")
        out = pairs.groupBy("pair").agg(F.count("*").alias("n")).join(rated.groupBy("pair").agg(F.count("*").alias("rated")), "pair", "left")
        return out.select(asof.alias("day"), "pair", "n", F.coalesce("rated", F.lit(0)).alias("rated"), (F.col("n") >= self.least).alias("ready"))

    def run(self, day: dt.date, stop_after: str | None = None) -> list[str]:
        """Run what is left of a day and name the stages that were run; `stop_after` breaks off behind a stage."""
        done = []
        for name in self.STAGES:
            store = self.store(name)
            told = store.manifest()
            if not told or told["done"].get(name, -1) < day.toordinal():
                store.write(self.stage(name, day), day.toordinal(), name)
                done.append(name)
            if name == stop_after:
                break
        return done

    def report(self) -> DataFrame:
        """day, pair, n, rated, ready of the readiness, with last and z of the first pass."""
        ready, econ = self.store("readiness").read(), self.store("econ").read()
        return ready.join(econ.select("day", "pair", "last", "z"), ["day", "pair"], "left")
