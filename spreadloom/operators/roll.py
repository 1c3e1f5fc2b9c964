"""Contract rolls: when to roll, and prices on both sides of a seam."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.operators import align

#: Weekdays before expiry from which the calendar asks for a roll.
DAYS = 5


def decide(held: DataFrame, market: str, days: int = DAYS) -> DataFrame:
    """`held` (asof, code, and for KRX vol_now, vol_next) with expiry, next_code, left, roll, reason.

    On KRX more volume in the next contract decides first; then, anywhere, the weekdays left to expiry (third
    Tuesday, first notice or last trading day by market).
    """
    month = c.krx_month(F.col("code"), F.col("asof")) if market == "KRX" else c.us_month(F.col("code"), F.col("asof"))
    expiry = {"KRX": c.third_tuesday, "CME": c.first_notice, "EUREX": c.last_trading}[market](F.col("month"))
    after = c.next_quarter(F.col("month"))
    code = c.krx_code(F.substring("code", 2, 2), after) if market == "KRX" else c.us_code(F.expr("left(code, length(code) - 3)"), after)
    out = held.withColumn("month", month).withColumn("expiry", expiry).withColumn("next_code", code)
    out = out.withColumn("left", c.weekdays_between(F.col("asof"), F.col("expiry")))
    volume = F.coalesce(F.col("vol_next") > F.col("vol_now"), F.lit(False)) if market == "KRX" else F.lit(False)
    reason = F.when(volume, "volume").when(F.col("left") <= days, "calendar").otherwise("none")
    return out.withColumn("reason", reason).withColumn("roll", F.col("reason") != "none").drop("month")


def seam_prices(events: DataFrame, closes: DataFrame) -> DataFrame:
    """`events` (instr, at, from_code, to_code) with px_from, the last close of the contract that is left at or before the
    roll, and px_to, the first of the one that comes at or after it. `closes` has instr, code, d, close."""
    prices = closes.select("instr", "code", F.col("d").alias("t"), F.col("close").alias("px"))
    rows = events.withColumnRenamed("at", "t")
    before = align.carried(rows.withColumn("code", F.col("from_code")), prices, ["instr", "code"], "px").select("instr", "t", "from_code", "to_code", F.col("px").alias("px_from"))
    after = align.carried(rows.withColumn("code", F.col("to_code")), prices, ["instr", "code"], "px", forward=True).select("instr", "t", "from_code", "to_code", F.col("px").alias("px_to"))
    return before.join(after, ["instr", "t", "from_code", "to_code"]).withColumnRenamed("t", "at")
