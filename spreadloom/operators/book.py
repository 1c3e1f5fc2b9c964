"""Order-book features and their power to predict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.functions.columns import correlation
from spreadloom.operators import align, scans
from spreadloom.operators.sessions import after


def features(quotes: DataFrame, keys: list[str], size: float = 10, flows: bool = True) -> DataFrame:
    """Per book (t, bids, asks): mid, spread_bps, obi, obi_levels, wmid, tilt, depth, cost (of `size`), and with `flows` voi, mlofi.

    voi and mlofi compare with the book before, of books of one time with the next lower by bids and asks, so that every run
    gives the same; they are null on the first book and after one without a price.
    """
    bid, ask = F.col("bids")[0], F.col("asks")[0]

    def valid(bids: str, asks: str) -> Column:
        b, a = F.col(bids)[0]["px"], F.col(asks)[0]["px"]
        return F.coalesce(b.isNotNull() & a.isNotNull() & (a > 0), F.lit(False))

    rows = scans.before(quotes.select(*keys, "t", "bids", "asks"), keys, "t", ["bids", "asks"], "old_") if flows else quotes
    rows = rows.where(valid("bids", "asks"))
    mid = c.mid(bid["px"], ask["px"])
    wmid = c.weighted_mid(bid["px"], ask["px"], bid["qty"], ask["qty"])

    def flow(i: int, side: str) -> Column:
        now, old = F.col(side)[i], F.col(f"old_.{side}")[i]
        return c.flow(now["px"], now["qty"], old["px"], old["qty"], side == "bids")

    def net(levels: int) -> Column:
        return F.when(valid("old_.bids", "old_.asks"), c.total([F.coalesce(flow(i, "bids"), F.lit(0.0)) - F.coalesce(flow(i, "asks"), F.lit(0.0)) for i in range(levels)]))

    return rows.select(
        *keys, "t", mid.alias("mid"), ((ask["px"] - bid["px"]) / mid * 1e4).alias("spread_bps"), c.imbalance(bid["qty"], ask["qty"]).alias("obi"),
        c.weighted_imbalance(F.col("bids"), F.col("asks")).alias("obi_levels"), wmid.alias("wmid"), (wmid - mid).alias("tilt"),
        c.depth_within(F.col("bids"), F.col("asks"), mid, 0.01).alias("depth"), c.liquidity_cost(F.col("bids"), F.col("asks"), size).alias("cost"),
        *([net(1).alias("voi"), net(5).alias("mlofi")] if flows else []))


def predictive(rows: DataFrame, key: str, names: list[str], minutes: float, least: int = 10) -> DataFrame:
    """key, name, n, corr of each feature with the change of mid to the first book `minutes` later."""
    due = rows.select(key, after(F.col("t"), minutes).alias("t"), "mid", *names)
    later = rows.select(key, "t", F.col("mid").alias("later"))
    met = align.carried(due, later, [key], "later", forward=True).where("later is not null")
    long = met.select(key, (F.col("later") - F.col("mid")).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in names])).alias("f"))
    long = long.select(key, "y", "f.name", "f.x").where("x is not null")
    return long.groupBy(key, "name").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation(F.col("x"), F.col("y"))).alias("corr"))


def refills(quotes: DataFrame, key: str, share: float = 0.5, within: int = 300) -> DataFrame:
    """key, side, t, seconds: from a drop of the best size by `share` or more until what stood before is back.

    Both sides are scanned by themselves, null sizes as 0. A drop is settled at the first later book that has the old
    size or comes more than `within` seconds after it; drops before that book belong to the same event, and the scan
    goes on behind it. Only sizes that are back after more than 0 and up to `within` seconds count.

    The first book with the old size is found by a join on time buckets of `within` seconds, so a drop only meets
    books that it can be settled by. Events follow from the drops alone: one that no earlier drop reaches begins a
    cluster, and within a cluster each event ends where the next may begin.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.coalesce(F.col(c)[0]["qty"], F.lit(0.0)).alias("qty")) for n, c in (("bid", "bids"), ("ask", "asks"))]))
    w = Window.partitionBy(key, "side").orderBy("t")
    rows = quotes.select(key, "t", sides.alias("s")).select(key, "t", "s.side", "s.qty")
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    rows = rows.withColumn("us", micros).withColumn("k", F.row_number().over(w)).withColumn("base", F.lag("qty").over(w))
    reach = within * 1_000_000
    rows = rows.withColumn("late", F.col("k") + F.count("*").over(Window.partitionBy(key, "side").orderBy("us").rangeBetween(1, reach)) + 1)
    drops = rows.where((F.col("base") > 0) & (F.col("qty") <= F.col("base") * (1 - share)))
    bucket = F.floor(F.col("us") / reach)
    asked = drops.select(key, "side", "k", "us", "base", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    there = rows.select(F.col(key).alias("key2"), F.col("side").alias("side2"), bucket.alias("bucket2"), F.col("k").alias("k2"), F.col("us").alias("us2"), F.col("qty").alias("qty2"))
    met = (F.col(key) == F.col("key2")) & (F.col("side") == F.col("side2")) & (F.col("bucket") == F.col("bucket2"))
    met = met & (F.col("k2") > F.col("k")) & (F.col("us2") <= F.col("us") + reach) & (F.col("qty2") >= F.col("base"))
    back = asked.join(there, met).groupBy(key, "side", "k").agg(F.min(F.struct("k2", "us2")).alias("back"))
    drops = drops.join(back, [key, "side", "k"], "left").select(
        key, "side", "t", "k", F.coalesce("back.k2", "late").alias("end"), ((F.col("back.us2") - F.col("us")) / 1e6).alias("seconds"))
    order = Window.partitionBy(key, "side").orderBy("k")
    starts = F.when(F.col("k") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    drops = drops.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("k", "end", "t", "seconds")
    clusters = drops.groupBy(key, "side", "cluster").agg(F.array_sort(F.collect_list(one)).alias("v"))
    none = F.slice("v", 1, 0)
    taken = F.aggregate("v", none, lambda got, x: F.when((F.size(got) == 0) | (F.element_at(got, -1)["end"] < x["k"]), F.concat(got, F.array(x))).otherwise(got))
    events = clusters.select(key, "side", F.explode(taken).alias("e")).select(key, "side", "e.t", "e.seconds")
    return events.where("seconds > 0")
