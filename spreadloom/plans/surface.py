"""Queries over the smaller surfaces: scans, listings, text and date helpers, order gates, records, streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.functions.columns import r6
from spreadloom.operators import bars, merge, models, roll, scans, sessions, signals, stats
from spreadloom.plans import series
from spreadloom.plans.desk import US, roll_sql
from spreadloom.plans.market import Catalog, Market
from spreadloom.plans.series import OLS
from spreadloom.plans.trading import LOCKS, SCORED, locks, scored
from spreadloom.sources import feeds, files
from spreadloom.sources.store import KeyedStore
from spreadloom.streaming import live

catalog = Catalog()
add = catalog.add


@add("s4_quote_tail", "SELECT instr, t, round(bids[1].px, 6) AS bid, round(asks[1].px, 6) AS ask FROM (SELECT *, row_number() OVER (PARTITION BY instr ORDER BY t DESC) AS k FROM quotes) WHERE k <= 200")
def quote_tail(m: Market) -> DataFrame:
    return stats.tail(m.quotes, ["instr"], "t", 200).select("instr", "t", r6(F.col("bids")[0]["px"]).alias("bid"), r6(F.col("asks")[0]["px"]).alias("ask"))


@add("s5_rate_scan", "SELECT t, rate FROM fx")
def rate_scan(m: Market) -> DataFrame:
    return m.fx


@add("s9_keyword_listing", "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(concat_ws(' ', p_name, p_brand, p_type), '(?i)1[0-9]?')")
def listing(m: Market) -> DataFrame:
    return m.table("part").where(F.concat_ws(" ", "p_name", "p_brand", "p_type").rlike("(?i)1[0-9]?")).select("p_partkey", "p_name", "p_brand")


@add("k5_rate_upsert", """
WITH o AS (SELECT time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, t) AS close FROM ticks WHERE instr = 'purchase' AND event_id % 3 <> 0 GROUP BY ALL), n AS (SELECT time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, t) AS close FROM ticks WHERE instr = 'purchase' AND event_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(o.t, n.t) AS t, coalesce(n.close, o.close) AS close, false AS active FROM o FULL JOIN n ON o.t = n.t""")
def rate_upsert(m: Market) -> DataFrame:
    part = lambda cond: bars.tick_bars(m.ticks.where("instr = 'purchase'").where(cond), f"{m.scale.bar} minutes").select("t", "close")
    return merge.upsert(part("event_id % 3 <> 0"), part("event_id % 2 = 0"), ["t"]).withColumn("active", F.lit(False))


@add("k10_roll_apply", """
WITH q AS (SELECT o_orderpriority AS instr, count(DISTINCT date_trunc('quarter', o_orderdate)) AS rolls, max(CAST(date_trunc('quarter', o_orderdate) AS DATE)) AS d0 FROM orders GROUP BY 1)
SELECT instr, rolls, CAST(d0 + INTERVAL 2 MONTH AS DATE) AS contract, 'ZN' || CASE month(d0 + INTERVAL 2 MONTH) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || strftime(d0 + INTERVAL 2 MONTH, '%y') AS symbol FROM q""")
def roll_apply(m: Market) -> DataFrame:
    """Instruments after all rolls: the symbol of the last event."""
    events = m.table("orders").select(F.col("o_orderpriority").alias("instr"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("at")).distinct()
    last = events.groupBy("instr").agg(F.count("*").alias("rolls"), F.max("at").alias("at"))
    month = F.add_months("at", 2)
    return last.select("instr", "rolls", month.alias("contract"), c.us_code(F.lit("ZN"), month).alias("symbol"))


@add("k11_operation_log", "SELECT event_type AS instr, CAST(ts AS DATE) AS d, count(*) AS n_rows, CASE WHEN count(*) < 60 THEN 'stale' ELSE 'ok' END AS status, left(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts), 50) AS detail FROM events GROUP BY ALL")
def operation_log(m: Market) -> DataFrame:
    rows = m.table("events").select(F.col("event_type").alias("instr"), F.to_date("ts").alias("d"), "ts", "event_id")
    counts = rows.groupBy("instr", "d").agg(F.count("*").alias("n_rows"))
    # an id and its comma are two characters at least, so the first 25 ids fill the 50 that are kept
    turn = F.row_number().over(Window.partitionBy("instr", "d").orderBy("ts"))
    first = rows.withColumn("k", turn).where("k <= 25").groupBy("instr", "d").agg(F.array_sort(F.collect_list(F.struct("k", "event_id"))).alias("v"))
    detail = F.left(F.array_join(F.transform("v", lambda x: x["event_id"].cast("string")), ","), F.lit(50))
    out = counts.join(first, ["instr", "d"])
    return out.select("instr", "d", "n_rows", F.when(F.col("n_rows") < 60, "stale").otherwise("ok").alias("status"), detail.alias("detail"))


@add("k12_scan_log", "SELECT p_brand AS product, count(*) AS contracts, sum(p_size) >= 2000 AS passed, CAST(max(p_partkey) AS VARCHAR) AS last_scan FROM part GROUP BY p_brand")
def scan_log(m: Market) -> DataFrame:
    return m.table("part").groupBy(F.col("p_brand").alias("product")).agg(F.count("*").alias("contracts"), (F.sum("p_size") >= 2000).alias("passed"), F.max("p_partkey").cast("string").alias("last_scan"))


@add("p4_contract_value", "SELECT b.instr, t, round(close * point, 4) AS value FROM bars b JOIN spec s ON b.instr = s.instr")
def contract_value(m: Market) -> DataFrame:
    return m.bars.join(m.spec, "instr").select("instr", "t", F.round(F.col("close") * F.col("point"), 4).alias("value"))


@add("p12_ranges_and_lists", "SELECT instr, count(*) AS n FROM bars WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND instr IN ('click', 'view') GROUP BY instr")
def ranges(m: Market) -> DataFrame:
    span = F.col("t").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return m.bars.where(span & F.col("instr").isin("click", "view")).groupBy("instr").agg(F.count("*").alias("n"))


@add("a31_session_volume", """WITH l AS (SELECT *, lag(t) OVER (PARTITION BY instr ORDER BY t) AS t0 FROM bars), s AS (SELECT *, CAST(sum(CASE WHEN t > t0 + INTERVAL '120 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY instr ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM l)
SELECT instr, sid, min(t) AS first_t, count(*) AS n, sum(volume) AS volume FROM s WHERE (instr, sid) IN (SELECT (instr, max(sid)) FROM s GROUP BY instr) GROUP BY instr, sid""")
def session_volume(m: Market) -> DataFrame:
    """Volume of the latest session of each instrument."""
    each = sessions.sessionize(m.bars, ["instr"], "t", m.scale.gap).groupBy("instr", "sid").agg(F.min("t").alias("first_t"), F.count("*").alias("n"), F.sum("volume").alias("volume"))
    last = each.groupBy("instr").agg(F.max_by(F.struct("sid", "first_t", "n", "volume"), "sid").alias("s"))
    return last.select("instr", "s.*")


@add("t1_recent_rows", "SELECT instr, t, close FROM bars ORDER BY t DESC, instr LIMIT 25")
def recent(m: Market) -> DataFrame:
    return m.bars.orderBy(F.desc("t"), "instr").limit(25).select("instr", "t", "close")


@add("t4_ranked_by_significance", f"WITH {OLS} SELECT pair, round(b / se, 5) AS t, row_number() OVER (ORDER BY round(coalesce(abs(b / se), 0), 5) DESC, pair) AS place FROM e")
def ranked_by_t(m: Market) -> DataFrame:
    fit = stats.ols(m.steps, "pair", "x", "d")
    # one row per pair
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.coalesce(F.nanvl(F.abs("t"), F.lit(0.0)), F.lit(0.0)), 5)), "pair")).cast("long")
    return fit.select("pair", F.round("t", 5).alias("t"), place.alias("place"))


@add("t9_history_listing", """WITH h AS (SELECT pair, CAST(t AS DATE) AS d, count(*) AS n, round(arg_max(s, t), 6) AS last FROM spread GROUP BY ALL)
SELECT CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY d) = 1 THEN '=== ' || pair || ' ===' END AS header, pair, d, n, last FROM h ORDER BY pair, d""")
def history_listing(m: Market) -> DataFrame:
    """Daily records by pair and time; the first of each pair carries the group's header."""
    days = m.spread.groupBy("pair", F.to_date("t").alias("d")).agg(F.count("*").alias("n"), r6(F.max_by("s", "t")).alias("last"))
    first = F.row_number().over(Window.partitionBy("pair").orderBy("d")) == 1
    return days.select(F.when(first, F.concat(F.lit("=== "), "pair", F.lit(" ==="))).alias("header"), "pair", "d", "n", "last").orderBy("pair", "d")


@add("t8_fixed_display_order", "SELECT event_type AS instr, count(*) AS n, CAST(list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS BIGINT) AS place FROM events GROUP BY event_type")
def display_order(m: Market) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ("view", "click", "signup", "purchase", "error"))), F.col("event_type"))
    return m.table("events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type").alias("instr"), "n", place.alias("place"))


@add("o4_latest_of_batches", "SELECT instr, arg_max(px, (b, t)) AS px FROM (SELECT instr, t, px, event_id % 8 AS b FROM ticks) GROUP BY instr")
def latest_of_batches(m: Market) -> DataFrame:
    return m.ticks.withColumn("b", F.col("event_id") % 8).groupBy("instr").agg(F.max_by("px", F.struct("b", "t")).alias("px"))


@add("f1_text_helpers", """SELECT o_orderkey, rpad(left(o_orderpriority, 5), 8, ' ') AS symbol, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 6, '0') AS clock, split_part(o_orderpriority, '-', 1) AS head, upper(right(o_orderpriority, 4)) AS tail FROM orders""")
def text_helpers(m: Market) -> DataFrame:
    p = F.col("o_orderpriority")
    return m.table("orders").select("o_orderkey", F.rpad(F.left(p, F.lit(5)), 8, " ").alias("symbol"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 6, "0").alias("clock"), F.split(p, "-")[0].alias("head"), F.upper(F.right(p, F.lit(4))).alias("tail"))


@add("f15_clock_helpers", "SELECT event_id, ts + INTERVAL 9 HOUR AS seoul, date_trunc('minute', ts) AS minute, CAST(isoyear(ts) AS INTEGER) * 100 + CAST(weekofyear(ts) AS INTEGER) AS week FROM events")
def clock_helpers(m: Market) -> DataFrame:
    week = F.expr("extract(yearofweek from ts)") * 100 + F.expr("extract(week from ts)")
    return m.table("events").select("event_id", (F.col("ts") + F.expr("interval 9 hours")).alias("seoul"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), week.cast("int").alias("week"))


@add("f17_guarded_math", "SELECT instr, t, round(tanh((close - 50) / 100), 9) AS squash, round(ln(1 + volume), 9) AS log_volume, CASE WHEN high - low > 1e-12 THEN round((close - low) / (high - low), 9) END AS place FROM bars")
def guarded_math(m: Market) -> DataFrame:
    span = F.col("high") - F.col("low")
    return m.bars.select("instr", "t", F.round(F.tanh((F.col("close") - 50) / 100), 9).alias("squash"), F.round(F.log1p("volume"), 9).alias("log_volume"), F.when(span > 1e-12, F.round((F.col("close") - F.col("low")) / span, 9)).alias("place"))


@add("f25_json_payloads", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 || '}' AS bumped FROM events""")
def json_payloads(m: Market) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return m.table("events").select("event_id", k.alias("k"), F.to_json(F.struct((k + 1).alias("k"))).alias("bumped"))


@add("g11_ecm_gate", f"WITH {OLS} SELECT pair, b < 0 AND b / se <= -1.64 AS open, CASE WHEN abs(b / se) > 1.96 THEN 'significant' ELSE 'weak' END AS label FROM e")
def ecm_gate(m: Market) -> DataFrame:
    fit = stats.ols(m.steps, "pair", "x", "d")
    return fit.select("pair", ((F.col("b") < 0) & (F.col("t") <= -1.64)).alias("open"), F.when(F.abs("t") > 1.96, "significant").otherwise("weak").alias("label"))


@add("g12_edge_gate", """
WITH k AS (SELECT pair, s, t, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM spread), g AS (SELECT pair, avg(s) AS mean, arg_max(s, t) AS last FROM k WHERE k <= 60 GROUP BY pair)
SELECT pair, round(abs(last - mean), 6) AS edge, round(2 * 1e-4 * abs(last) + 4 * 0.01, 6) AS cost, abs(last - mean) > 2 * 1e-4 * abs(last) + 4 * 0.01 AS open FROM g""")
def edge_gate(m: Market) -> DataFrame:
    g = stats.tail(m.spread, ["pair"], "t", 60).groupBy("pair").agg(F.avg("s").alias("mean"), F.max_by("s", "t").alias("last"))
    edge, cost = F.abs(F.col("last") - F.col("mean")), 2 * F.lit(1e-4) * F.abs("last") + 4 * F.lit(0.01)
    return g.select("pair", r6(edge).alias("edge"), r6(cost).alias("cost"), (edge > cost).alias("open"))


@add("g28_order_gate", f"WITH {OLS}, {LOCKS}, o AS (SELECT pair, CASE WHEN z > 0 THEN 'live' ELSE 'dry' END AS mode, CAST(ceil(abs(z) * 3) AS BIGINT) AS qty FROM r) SELECT pair, mode, qty, CASE WHEN mode = 'dry' THEN 'logged' ELSE 'blocked' END AS status, qty <= 5 AS within_limit FROM o")
def order_gate(m: Market) -> DataFrame:
    """Dry orders are logged, live ones always blocked: nothing here is connected to a broker."""
    mode = F.when(F.col("z") > 0, "live").otherwise("dry")
    qty = F.ceil(F.abs("z") * 3)
    return locks(m).select("pair", mode.alias("mode"), qty.alias("qty"), F.when(mode == "dry", "logged").otherwise("blocked").alias("status"), (qty <= 5).alias("within_limit"))


@add("g31_probe_groups", "SELECT o_orderstatus AS grp, count(DISTINCT o_orderpriority) AS tried, count(DISTINCT o_orderpriority) FILTER (o_totalprice > 100000) AS received FROM orders GROUP BY 1")
def probe_groups(m: Market) -> DataFrame:
    return m.table("orders").groupBy(F.col("o_orderstatus").alias("grp")).agg(
        F.count_distinct("o_orderpriority").alias("tried"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))).alias("received"))


def walk_sql(thresholds: str) -> str:
    """Marked positions r (pair, sid, t, thr, pos, r) entered at each threshold and left at 0.25."""
    return f"""{SCORED}, th AS (SELECT unnest({thresholds}) AS thr), w AS (SELECT pair, sid, t, k, s, z, thr, CASE WHEN abs(z) >= thr THEN -CAST(sign(z) AS INTEGER) ELSE 0 END AS pos FROM sc, th WHERE k = 1
UNION ALL SELECT x.pair, x.sid, x.t, x.k, x.s, x.z, w.thr, CASE WHEN x.z IS NULL THEN w.pos WHEN w.pos = 0 AND abs(x.z) >= w.thr THEN -CAST(sign(x.z) AS INTEGER) WHEN w.pos <> 0 AND abs(x.z) <= 0.25 THEN 0 ELSE w.pos END FROM w JOIN sc x ON x.pair = w.pair AND x.sid = w.sid AND x.k = w.k + 1),
r AS (SELECT *, coalesce(lag(pos) OVER o * (s - lag(s) OVER o), 0) AS r FROM w WINDOW o AS (PARTITION BY pair, sid, thr ORDER BY t))"""


@add("g9_threshold_sweep", f"WITH RECURSIVE {walk_sql('[1.0::DOUBLE, 1.5, 2.0]')} SELECT pair, thr AS threshold, round(sum(r), 5) AS net, count(*) FILTER (pos <> 0) AS held FROM r GROUP BY ALL")
def threshold_sweep(m: Market) -> DataFrame:
    """Positions at three thresholds, marked to market."""
    thresholds = (1.0, 1.5, 2.0)
    z = scored(m).select("pair", "sid", "t", "s", "z", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    keys = ["pair", "sid", "threshold"]
    pos = reduce(DataFrame.unionByName, [signals.held(z.where(F.col("threshold") == v), keys, "t", "z", v, 0.25) for v in thresholds])
    w = Window.partitionBy("pair", "sid", "threshold").orderBy("t")
    r = z.join(pos, ["pair", "sid", "threshold", "t"]).withColumn("r", F.coalesce(F.lag("pos").over(w) * (F.col("s") - F.lag("s").over(w)), F.lit(0.0)))
    return r.groupBy("pair", "threshold").agg(F.round(F.sum("r"), 5).alias("net"), F.count_if(F.col("pos") != 0).alias("held"))


@add("g22_posterior_predictive")
def posterior_predictive(m: Market) -> DataFrame:
    draws = models.posterior(m.steps, "pair", "t", "x", "d", cost=5.0)
    return draws.groupBy("pair").agg(F.avg("pnl").alias("mean"), F.percentile("pnl", 0.05).alias("low"), F.percentile("pnl", 0.95).alias("high"), F.avg((F.col("pnl") > 0).cast("double")).alias("p_over_cost"))


@add("g25_roll_decision_cme", roll_sql("", US.format("m"), US.format("n"), "CAST(pe - greatest(isodow(pe) - 5, 0)::INTEGER AS DATE)", "false"))
def roll_decision_cme(m: Market) -> DataFrame:
    days = m.table("orders").select(F.to_date("o_orderdate").alias("asof")).distinct()
    return roll.decide(days.withColumn("code", c.us_code(F.lit("ZN"), F.add_months(F.trunc("asof", "quarter"), 2))), "CME")


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spreadloom-")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(m: Market, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Rows of a stream over the event files, each batch in a folder of its own; in complete mode the last batch has all."""
    folder = scratch(m.spark)
    events = m.spark.readStream.schema(m.table("events").schema).parquet(f"{m.dir}/events.parque[t]")
    ticks = events.where("value > 0").select(F.col("event_type").alias("instr"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("px"))
    part = (lambda k: f"{folder}/rows/batch={k}") if mode == "append" else (lambda k: f"{folder}/rows/batch=0")
    live.run_available(build(ticks), f"{folder}/check", mode=mode, each=lambda batch, k: batch.write.mode("overwrite").parquet(part(k)))
    return m.spark.read.parquet(f"{folder}/rows").drop("batch")


@add("x4_activity_sessions", """WITH g AS (SELECT instr, t, CASE WHEN t < lag(t) OVER w + INTERVAL '60 minutes' THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY instr ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY instr ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT instr, min(t) AS "first", max(t) + INTERVAL '60 minutes' AS "end", count(*) AS n FROM s GROUP BY instr, k""")
def activity_sessions(m: Market) -> DataFrame:
    """Sessions of activity by a session window on a stream of late ticks, each as soon as the watermark closes it."""
    return replayed(m, m.ticks.select("instr", "t"), "instr", lambda ticks: live.activity(ticks, "60 minutes", "240 minutes"))


@add("x6_once_a_second", "SELECT DISTINCT instr, date_trunc('second', t) AS t FROM ticks")
def once_a_second(m: Market) -> DataFrame:
    """Instruments and seconds with a tick, repeats within the watermark dropped on the stream."""
    out = streamed(m, lambda ticks: live.once(ticks.select("instr", F.date_trunc("second", "t").alias("t")), "1 hour", ["instr", "t"]), "append")
    return out.withColumn("t", F.col("t").cast("timestamp_ntz"))


@add("x1_streamed_bars", "SELECT instr, t, open, high, low, close, volume, n FROM bars")
def streamed_bars(m: Market) -> DataFrame:
    """The bars by Structured Streaming over the event files: what a batch changes goes to a keyed store."""
    folder = scratch(m.spark)
    events = m.spark.readStream.schema(m.table("events").schema).parquet(f"{m.dir}/events.parque[t]")
    ticks = events.where("value > 0").select(F.col("event_type").alias("instr"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("px"), F.get_json_object("props", "$.k").cast("double").alias("qty"))
    keys = ["instr", "t"]
    live.run_available(live.bars(ticks, f"{m.scale.bar} minutes", "1 hour"), f"{folder}/check", mode="update", each=live.keyed_sink(f"{folder}/bars", keys, 8))
    return KeyedStore(m.spark, f"{folder}/bars", keys).read().withColumn("t", F.col("t").cast("timestamp_ntz"))


def replayed(m: Market, rows: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], minutes: int = 240, batches: int = 4) -> DataFrame:
    """What a stream makes of `rows` (with `key` and t) that come in `batches`, up to 80 % of `minutes` late and in no
    order, and of a heartbeat at the end that lets the watermark pass them all."""
    folder = scratch(m.spark)
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    own = rows.withColumn("t", F.col("t").cast("timestamp"))
    us = F.unix_micros("t")
    low, high = own.agg(F.min(us), F.max(us)).first()
    width = (high - low + minutes * 60_000_000) // batches + 1
    drift = F.pmod(F.xxhash64(key, "t"), F.lit(minutes * 48_000_000))
    own = own.withColumn("batch", F.floor((us + drift - low) / width)).repartition(4)
    for k in range(batches):
        own.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{folder}/in")
    last = own.drop("batch").limit(1)
    beat = last.select(*[F.lit("").alias(c) if c == key else F.timestamp_micros(F.lit(high + 3 * minutes * 60_000_000)).alias(c) if c == "t" else F.lit(None).cast(k).alias(c) for c, k in last.dtypes])
    beat.write.mode("append").parquet(f"{folder}/in")
    stream = live.ticks_from(m.spark, f"{folder}/in", own.drop("batch").schema, files=4)
    live.run_available(build(stream), f"{folder}/check", each=lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"))
    out = m.spark.read.parquet(f"{folder}/out").drop("batch").where(F.col(key) != "")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in out.dtypes if k == "timestamp"})


@add("x2_late_counter_bars", series.COUNTER_BARS)
def late_counter_bars(m: Market) -> DataFrame:
    """Bars of counter sizes, from ticks that come late and in no order."""
    ticks = m.ticks.select("instr", "t", "px", (F.col("event_id") * 7 % 1000).cast("double").alias("totq"))
    sized = replayed(m, ticks, "instr", lambda rows: live.counter_sizes(rows, "240 minutes"))
    return bars.tick_bars(sized, f"{m.scale.bar} minutes").select("instr", "t", "close", "volume")


@add("x5_streamed_scores", series.rolling_sql("pair, sid", "119 PRECEDING AND CURRENT ROW", 30))
def streamed_scores(m: Market) -> DataFrame:
    """Rolling scores of spreads within sessions, from values that come late and in no order."""
    values = m.spread.select(F.col("pair").alias("key"), "t", F.col("s").alias("x"))
    out = replayed(m, values, "key", lambda rows: live.rolling_scores(rows, 120, 30, m.scale.gap, "240 minutes"))
    return series.rolled(out.withColumnRenamed("key", "pair"))


@add("x8_keyed_store", """
WITH k AS (SELECT *, (event_id % 4) * 1000000000000 + event_id AS place FROM ticks)
SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, place) AS px, max(px) AS high, arg_min(px, place) AS first_px,
 coalesce(arg_max(CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END, CASE WHEN event_id % 3 = 0 THEN place END), '') AS note FROM k GROUP BY ALL""")
def keyed_store(m: Market) -> DataFrame:
    """Four batches of ticks, each written twice, in a keyed store: last price, highest, first, last note that says anything."""
    store = KeyedStore(m.spark, f"{scratch(m.spark)}/store", ["instr", "t"], 8, ("event_id",), keep=("first_px",), largest=("high",), guard=("note",))
    note = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("")
    rows = m.ticks.select("instr", F.window("t", f"{m.scale.bar} minutes").start.alias("t"), "px", F.col("px").alias("high"), F.col("px").alias("first_px"), note.alias("note"), "event_id")
    for k in range(4):
        for _ in range(2):
            store.write(rows.where(F.col("event_id") % 4 == k), k)
    return store.read().drop("event_id")


@add("s8_paged_source", "SELECT instr, t, open, high, low, close, volume FROM bars")
def paged_source(m: Market) -> DataFrame:
    """The bars, laid out in pages behind cursors and pulled from there: one page names no next, others name themselves."""
    folder = scratch(m.spark)
    rows = scans.numbered(m.bars.select("instr", "t", "open", "high", "low", "close", "volume"), ["instr"], "t", "k")
    pages = rows.withColumn("page", F.floor(F.col("k") / 100)).groupBy("instr", "page").agg(F.sort_array(F.collect_list(F.struct("t", "open", "high", "low", "close", "volume"))).alias("rows"), F.max("k").alias("k"))
    last = F.col("page") == F.max("page").over(Window.partitionBy("instr"))
    then = F.when(~last, F.col("page") + 1).when(F.col("instr") < "purchase", F.col("page"))
    text = F.to_json(F.struct("rows", F.coalesce(then.cast("string"), F.lit("")).alias("next")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    pages.select("instr", F.col("page").alias("cursor"), text.alias("value")).repartition("instr", "cursor").write.partitionBy("instr", "cursor").text(f"{folder}/pages")
    m.spark.dataSource.register(feeds.PagedBars)
    return m.spark.read.format("paged_bars").option("path", f"{folder}/pages").load()


@add("x7_demultiplexed", "SELECT 'trade' AS kind, instr, t, px FROM ticks UNION ALL SELECT 'quote', instr, t, bids[2].px FROM quotes")
def demultiplexed(m: Market) -> DataFrame:
    """Trades and quotes of one feed in two keyed stores. The feed is read up to its middle, then by a restarted query, and
    a third one has lost its checkpoint and reads it all again: everything lands once. The key of a message is its place in
    the feed, as an instrument may have any number of messages at one time, alike or not."""
    folder, keys = scratch(m.spark), ("segment", "line")
    stamp = F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    trades = m.ticks.select(F.to_json(F.struct("instr", F.col("px").alias("price"), stamp.alias("chetime"))).alias("value"))
    quotes = m.quotes.select(F.to_json(F.struct("instr", F.col("bids")[1]["px"].alias("bidho2"), stamp.alias("hotime"))).alias("value"))
    segments = 4 * (1 + m.table("events").count() // 1_000_000)
    # an empty line in every segment: later ones wait for one that is not there
    heads = m.spark.range(segments).select(F.lit("").alias("value"), F.col("id").alias("segment"))
    rows = trades.unionByName(quotes).withColumn("segment", F.pmod(F.xxhash64("value"), F.lit(segments))).unionByName(heads)
    m.spark.dataSource.register(feeds.Feed)

    def run(number: int) -> None:
        stream = m.spark.readStream.format("feed").option("path", f"{folder}/in").load()
        own = lambda t, px: lambda batch, k: store(t).write(batch.select(*keys, "instr", F.to_timestamp_ntz(t).alias("t"), F.col(px).cast("double").alias("px")), k, f"run{number // 2}")
        schema = "instr string, price double, chetime string, bidho2 double, hotime string"
        live.run_available(stream, f"{folder}/check{number // 2}", each=live.demultiplexed(schema, own("chetime", "price"), own("hotime", "bidho2"), keys))

    store = lambda t: KeyedStore(m.spark, f"{folder}/{t}", list(keys), 2 * segments)
    for number, part in enumerate((f"segment < {segments // 2}", f"segment >= {segments // 2}", "false")):
        rows.where(part).repartition("segment").write.mode("append").partitionBy("segment").text(f"{folder}/in")
        run(number)
    kinds = [store(t).read().select(F.lit(kind).alias("kind"), "instr", "t", "px") for t, kind in (("chetime", "trade"), ("hotime", "quote"))]
    return kinds[0].unionByName(kinds[1])
