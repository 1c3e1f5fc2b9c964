"""Queries over stores and their upkeep: merges, audits, rolls, serving frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.functions.columns import r6
from spreadloom.operators import align, bars, merge, quality, roll, sessions
from spreadloom.plans.market import Catalog, Market
from spreadloom.plans.series import HOLES, holes

catalog = Catalog()
add = catalog.add

STORES = """o AS (SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, t) AS close, sum(qty) AS volume, 'A' AS symbol FROM ticks WHERE event_id % 3 <> 0 GROUP BY ALL),
n AS (SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, t) AS close, sum(qty) AS volume, CASE WHEN hour(time_bucket(INTERVAL '1 hour', t)) < 12 THEN 'B' ELSE '' END AS symbol FROM ticks WHERE event_id % 2 = 0 GROUP BY ALL)"""


def stores(m: Market) -> tuple[DataFrame, DataFrame]:
    """Two overlapping bar tables, from different parts of the ticks."""
    width = f"{m.scale.bar} minutes"
    old = bars.tick_bars(m.ticks.where("event_id % 3 <> 0"), width).select("instr", "t", "close", "volume", F.lit("A").alias("symbol"))
    new = bars.tick_bars(m.ticks.where("event_id % 2 = 0"), width).select("instr", "t", "close", "volume", F.when(F.hour("t") < 12, "B").otherwise("").alias("symbol"))
    return old, new


def merged_sql(volume: str, symbol: str) -> str:
    return f"WITH {STORES} SELECT coalesce(o.instr, n.instr) AS instr, coalesce(o.t, n.t) AS t, coalesce(n.close, o.close) AS close, {volume} AS volume, {symbol} AS symbol FROM o FULL JOIN n ON o.instr = n.instr AND o.t = n.t"


KEYS = ["instr", "t"]


@add("k1_upsert_keep_symbol", merged_sql("coalesce(n.volume, o.volume)", "coalesce(o.symbol, n.symbol)"))
def upsert_keep(m: Market) -> DataFrame:
    return merge.upsert(*stores(m), KEYS, keep=("symbol",))


@add("k2_upsert_largest_volume", merged_sql("greatest(n.volume, o.volume)", "coalesce(o.symbol, n.symbol)"))
def upsert_largest(m: Market) -> DataFrame:
    return merge.upsert(*stores(m), KEYS, keep=("symbol",), largest=("volume",))


@add("k3_upsert_all", merged_sql("coalesce(n.volume, o.volume)", "coalesce(n.symbol, o.symbol)"))
def upsert_all(m: Market) -> DataFrame:
    return merge.upsert(*stores(m), KEYS)


@add("k17_upsert_guarded", merged_sql("coalesce(n.volume, o.volume)", "CASE WHEN o.t IS NULL THEN n.symbol ELSE coalesce(nullif(n.symbol, ''), o.symbol) END"))
def upsert_guarded(m: Market) -> DataFrame:
    return merge.upsert(*stores(m), KEYS, guard=("symbol",))


@add("k4_insert_absent", f"WITH {STORES} SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.instr = n.instr AND o.t = n.t)")
def insert_absent(m: Market) -> DataFrame:
    return merge.insert_absent(*stores(m), KEYS)


@add("k6_partial_quote_upsert", """
SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_max(bids[1].px, t) AS bp1, arg_max(asks[1].px, t) AS ap1, arg_min(bids[2].px, t) AS bp2, arg_min(asks[2].px, t) AS ap2 FROM quotes GROUP BY ALL""")
def partial_quotes(m: Market) -> DataFrame:
    # ticks are at most one a second, so the hour stands for the second here
    flat = m.quotes.select("instr", F.date_trunc("hour", "t").cast("timestamp_ntz").alias("h"), "t", *[F.col(f"{s}s")[i - 1]["px"].alias(f"{s[0]}p{i}") for s in ("bid", "ask") for i in (1, 2)])
    out = flat.groupBy("instr", "h").agg(F.max_by("bp1", "t").alias("bp1"), F.max_by("ap1", "t").alias("ap1"), F.min_by("bp2", "t").alias("bp2"), F.min_by("ap2", "t").alias("ap2"))
    return out.withColumnRenamed("h", "t")


@add("k7_append_once", f"WITH {STORES} SELECT instr, min(t) AS t FROM o GROUP BY instr UNION ALL SELECT instr, t FROM n WHERE (instr, t) NOT IN (SELECT instr, min(t) FROM o GROUP BY instr)")
def append_once(m: Market) -> DataFrame:
    old, new = stores(m)
    history = old.groupBy("instr").agg(F.min("t").alias("t"))
    return merge.append_once(history, new.select("instr", "t").union(new.select("instr", "t")), KEYS)


STATE = f"""{HOLES}, o AS (SELECT instr, gap_from, gap_to - INTERVAL '1 hour' AS gap_to, minutes - 60 AS minutes, 1 AS first_seen, 1 AS last_seen FROM h WHERE hour(gap_from) < 12), n AS (SELECT *, 2 AS seen FROM h WHERE minutes > 60)"""


@add("k8_gap_state", f"""WITH {STATE} SELECT coalesce(o.instr, n.instr) AS instr, coalesce(o.gap_from, n.gap_from) AS gap_from, coalesce(n.gap_to, o.gap_to) AS gap_to, coalesce(n.minutes, o.minutes) AS minutes,
 coalesce(o.first_seen, n.seen) AS first_seen, coalesce(n.seen, o.last_seen) AS last_seen FROM o FULL JOIN n ON o.instr = n.instr AND o.gap_from = n.gap_from""")
def gap_state(m: Market) -> DataFrame:
    h, bar = holes(m), m.scale.bar
    old = h.where(F.hour("gap_from") < 12).select("instr", "gap_from", sessions.after(F.col("gap_to"), -bar).alias("gap_to"), (F.col("minutes") - bar).alias("minutes"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"))
    return merge.gap_state(old, h.where(F.col("minutes") > bar).withColumn("seen", F.lit(2)), ["instr", "gap_from"])


@add("k9_close_gaps", f"""WITH {STORES}, g AS (SELECT instr, t0 + INTERVAL '60 minutes' AS gap_from, t - INTERVAL '60 minutes' AS gap_to, date_diff('minute', t0, t) - 60 AS minutes FROM
 (SELECT instr, t, lag(t) OVER (PARTITION BY instr ORDER BY t) AS t0 FROM o) WHERE date_diff('minute', t0, t) > 60)
SELECT g.*, EXISTS (SELECT 1 FROM n WHERE n.instr = g.instr AND n.t BETWEEN g.gap_from AND g.gap_to) AS filled FROM g""")
def close_gaps(m: Market) -> DataFrame:
    old, new = stores(m)
    return merge.close_gaps(sessions.holes(old, ["instr"], "t", m.scale.bar), new, False, m.scale.bar)


@add("p9_wrapping_window", "SELECT instr, count(*) AS n FROM bars WHERE hour(t) * 60 + minute(t) >= 1080 OR hour(t) * 60 + minute(t) <= 300 GROUP BY instr")
def wrapping_window(m: Market) -> DataFrame:
    minute = F.hour("t") * 60 + F.minute("t")
    return m.bars.where(c.in_window(minute, F.lit(1080), F.lit(300))).groupBy("instr").agg(F.count("*").alias("n"))


@add("p10_prefix_predicates", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR starts_with(o_orderpriority, '5') GROUP BY 1")
def prefixes(m: Market) -> DataFrame:
    return m.table("orders").where(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").like("5%")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@add("p11_sound_bars", """SELECT instr, count(*) AS n, count(*) FILTER (close BETWEEN 5 AND 150 AND high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0) AS sound FROM bars GROUP BY instr""")
def sound_bars(m: Market) -> DataFrame:
    return m.bars.groupBy("instr").agg(F.count("*").alias("n"), F.count_if(quality.sound(5, 150)).alias("sound"))


@add("p13_source_class", "SELECT CASE WHEN props LIKE '%\"k\": 9%' THEN 'external' ELSE 'own' END AS source, count(*) AS n FROM events GROUP BY 1")
def source_class(m: Market) -> DataFrame:
    return m.table("events").groupBy(F.when(F.col("props").contains('"k": 9'), "external").otherwise("own").alias("source")).agg(F.count("*").alias("n"))


@add("p14_trade_date", "SELECT instr, CAST(t AS DATE) - CASE WHEN hour(t) < 6 THEN 1 ELSE 0 END AS d, count(*) AS n FROM bars GROUP BY ALL")
def trade_dates(m: Market) -> DataFrame:
    return m.bars.groupBy("instr", c.trade_date(F.col("t")).alias("d")).agg(F.count("*").alias("n"))


@add("p15_synthesised_dates", """
WITH r AS (SELECT event_type AS instr, event_id, strftime(ts, '%H:%M:%S.%f') AS clock, CAST(max(ts) OVER (PARTITION BY event_type) AS DATE) AS base, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events),
x AS (SELECT *, CASE WHEN clock > lag(clock) OVER (PARTITION BY instr ORDER BY k) THEN 1 ELSE 0 END AS up FROM r)
SELECT instr, event_id, base - CAST(sum(up) OVER (PARTITION BY instr ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS day FROM x""")
def synthesised_dates(m: Market) -> DataFrame:
    w = Window.partitionBy("event_type")
    rows = m.table("events").select(F.col("event_type").alias("instr"), "event_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("clock"), F.to_date(F.max("ts").over(w)).alias("base"), F.row_number().over(w.orderBy(F.desc("ts"))).alias("k"))
    return quality.dated(rows, "instr", "k", "clock", F.col("base")).select("instr", "event_id", "day")


@add("p16_batch_validator", """
WITH r AS (SELECT event_id // 100 AS batch, CAST(ts AS DATE) - CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS d FROM events)
SELECT batch, count(*) AS n, count(DISTINCT d) AS dates, bool_or(isodow(d) >= 6) AS weekend, NOT bool_or(isodow(d) >= 6) AND count(DISTINCT d) <= 2 AS accepted FROM r GROUP BY batch""")
def batch_validator(m: Market) -> DataFrame:
    rows = m.table("events").select(F.floor(F.col("event_id") / 100).alias("batch"), "ts")
    return quality.batches(rows, "batch", "ts")


@add("p17_freshness", "SELECT instr, max(t) AS last_t, date_diff('minute', max(t), (SELECT max(t) FROM bars)) AS age FROM bars GROUP BY instr")
def freshness(m: Market) -> DataFrame:
    return quality.freshness(m.bars, "instr", "t", m.bars.agg(F.max("t").alias("asof")))


@add("p18_safe_numbers", "SELECT count(*) AS n, count(x) AS numbers, CAST(sum(x) AS BIGINT) AS total FROM (SELECT TRY_CAST(trim(substr(o_orderpriority, 1, CAST(1 + o_orderkey % 3 AS INTEGER))) AS DOUBLE) AS x FROM orders)")
def safe_numbers(m: Market) -> DataFrame:
    text = F.substring(F.col("o_orderpriority"), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))
    return m.table("orders").select(c.number(text).alias("x")).agg(F.count("*").alias("n"), F.count("x").alias("numbers"), F.sum("x").cast("long").alias("total"))


@add("p19_minute_key", "SELECT event_id, date_trunc('minute', ts) AS t FROM events")
def minute_key(m: Market) -> DataFrame:
    text = F.date_format("ts", "yyyyMMddHHmmss")
    return m.table("events").select("event_id", F.date_trunc("minute", F.to_timestamp_ntz(text, F.lit("yyyyMMddHHmmss"))).cast("timestamp_ntz").alias("t"))


@add("p20_sufficiency", "SELECT pair, n, CASE WHEN n < 30 THEN 'too few' WHEN n < 600 THEN 'estimate only' ELSE 'ok' END AS status FROM (SELECT pair, count(*) AS n FROM aligned GROUP BY pair)")
def sufficiency(m: Market) -> DataFrame:
    n = m.aligned.groupBy("pair").agg(F.count("*").alias("n"))
    return n.withColumn("status", F.when(F.col("n") < 30, "too few").when(F.col("n") < 600, "estimate only").otherwise("ok"))


WINDOWS = [("click", 540, 945, 5), ("error", 1080, 300, 12), ("purchase", 420, 360, 60), ("signup", 0, 1439, 10), ("view", 0, 1439, 240)]


@add("g27_stale_watchdog", f"""
WITH w AS (SELECT * FROM (VALUES {', '.join(map(str, WINDOWS))}) v(instr, opens, closes, tolerance)), a AS (SELECT max(t) AS seen FROM bars),
x AS (SELECT b.instr, date_diff('minute', max(b.t), any_value(seen)) AS age, any_value(hour(seen) * 60 + minute(seen)) AS mins FROM bars b, a GROUP BY b.instr)
SELECT x.instr, age, CASE WHEN NOT (CASE WHEN opens <= closes THEN mins BETWEEN opens AND closes ELSE mins >= opens OR mins <= closes END) THEN 'closed' WHEN age > tolerance THEN 'stale' ELSE 'ok' END AS state FROM x JOIN w ON x.instr = w.instr""")
def watchdog(m: Market) -> DataFrame:
    asof = m.bars.agg(F.max("t").alias("asof"))
    ages = quality.freshness(m.bars, "instr", "t", asof).join(F.broadcast(asof))
    windows = m.spark.createDataFrame(WINDOWS, "instr string, opens int, closes int, tolerance int")
    return quality.stale(ages, windows, F.hour("asof") * 60 + F.minute("asof")).select("instr", "age", "state")


@add("a27_health_rollup", f"""WITH {HOLES}, s AS (SELECT instr, count(*) AS n, date_diff('minute', min(t), max(t)) + 60 AS span FROM bars GROUP BY instr), g AS (SELECT instr, count(*) AS holes, sum(minutes) AS missing FROM h GROUP BY instr)
SELECT s.instr, n, span, coalesce(holes, 0) AS holes, CAST(coalesce(missing, 0) AS BIGINT) AS missing, round(1 - coalesce(missing, 0) / span, 6) AS coverage FROM s LEFT JOIN g ON s.instr = g.instr""")
def health(m: Market) -> DataFrame:
    size = m.bars.groupBy("instr").agg(F.count("*").alias("n"), (F.timestamp_diff("MINUTE", F.min("t"), F.max("t")) + m.scale.bar).alias("span"))
    gaps = holes(m).groupBy("instr").agg(F.count("*").alias("holes"), F.sum("minutes").alias("missing"))
    out = size.join(gaps, "instr", "left").fillna(0, ["holes", "missing"])
    return out.withColumn("coverage", r6(1 - F.col("missing") / F.col("span")))


@add("a28_collection_gain", f"WITH {STORES}, a AS (SELECT instr, count(*) AS n FROM o GROUP BY instr), b AS (SELECT instr, count(*) AS n FROM n GROUP BY instr) SELECT coalesce(a.instr, b.instr) AS instr, coalesce(b.n, 0) - coalesce(a.n, 0) AS gain FROM a FULL JOIN b ON a.instr = b.instr")
def gain(m: Market) -> DataFrame:
    before, after = (x.groupBy("instr").agg(F.count("*").alias(k)) for x, k in zip(stores(m), ("was", "now"), strict=True))
    return before.join(after, "instr", "full").select("instr", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("gain"))


@add("t5_fresh_first_selection", "SELECT pair, z FROM (SELECT pair, round(z, 6) AS z, row_number() OVER (ORDER BY last_t DESC, abs(round(z, 6)) DESC, pair) AS k FROM (SELECT pair, max(t) AS last_t, (arg_max(s, t) - avg(s)) / stddev_pop(s) AS z FROM spread GROUP BY pair)) WHERE k <= 4")
def selection(m: Market) -> DataFrame:
    z = m.spread.groupBy("pair").agg(F.max("t").alias("last_t"), r6(c.zscore(F.max_by("s", "t"), F.avg("s"), F.stddev_pop("s"))).alias("z"))
    return z.orderBy(F.desc("last_t"), F.desc(F.abs("z")), "pair").limit(4).select("pair", "z")


@add("t6_ranked_universe", "SELECT instr, volume, volume >= 100000 AS passed, row_number() OVER (ORDER BY volume DESC, instr) AS place FROM (SELECT instr, sum(volume) AS volume FROM bars GROUP BY instr)")
def universe(m: Market) -> DataFrame:
    v = m.bars.groupBy("instr").agg(F.sum("volume").alias("volume"))
    # one row per instrument
    return v.select("instr", "volume", (F.col("volume") >= 100000).alias("passed"), F.row_number().over(Window.orderBy(F.desc("volume"), "instr")).cast("long").alias("place"))


@add("o1_union_of_keys", f"WITH {STORES} SELECT instr, t FROM o UNION SELECT instr, t FROM n")
def union_keys(m: Market) -> DataFrame:
    old, new = stores(m)
    return old.select(*KEYS).union(new.select(*KEYS)).distinct()


@add("o2_common_keys", f"WITH {STORES} SELECT instr, t FROM o INTERSECT SELECT instr, t FROM n")
def common_keys(m: Market) -> DataFrame:
    old, new = stores(m)
    return old.select(*KEYS).intersect(new.select(*KEYS))


@add("o3_missing_keys", f"WITH {STORES} SELECT instr, t FROM n EXCEPT SELECT instr, t FROM o")
def missing_keys(m: Market) -> DataFrame:
    old, new = stores(m)
    return new.select(*KEYS).subtract(old.select(*KEYS))


@add("s17_feed_probe", "SELECT event_type AS symbol, count(*) AS ticks, arg_max(value, ts) AS last_px, CASE WHEN count(*) > 2000 THEN 'alive' ELSE 'thin' END AS verdict FROM events GROUP BY 1")
def feed_probe(m: Market) -> DataFrame:
    out = m.table("events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("ticks"), F.max_by("value", "ts").alias("last_px"))
    return out.withColumn("verdict", F.when(F.col("ticks") > 2000, "alive").otherwise("thin"))


ROLLS = """ev AS (SELECT o_orderpriority AS instr, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS at, round(sum(o_totalprice) / 1e6, 4) AS gap FROM orders GROUP BY ALL)"""


def roll_events(m: Market) -> DataFrame:
    """A roll at the start of each quarter with a price gap derived from its orders."""
    return m.table("orders").groupBy(F.col("o_orderpriority").alias("instr"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("at")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("gap"))


@add("w19_back_adjusted", f"WITH {ROLLS} SELECT d.instr, d.d, round(d.close + coalesce((SELECT sum(gap) FROM ev WHERE ev.instr = d.instr AND ev.at > d.d), 0), 4) AS adjusted FROM daily d")
def back_adjusted(m: Market) -> DataFrame:
    out = align.later_sum(m.daily, roll_events(m), ["instr"], "d", "at", "gap")
    return out.select("instr", "d", F.round(F.col("close") + F.col("later"), 4).alias("adjusted"))


@add("j12_later_gaps_inclusive", f"WITH {ROLLS} SELECT d.instr, d.d, round(coalesce((SELECT sum(gap) FROM ev WHERE ev.instr = d.instr AND ev.at >= d.d), 0), 4) AS later FROM daily d")
def later_gaps(m: Market) -> DataFrame:
    return align.later_sum(m.daily, roll_events(m), ["instr"], "d", "at", "gap", inclusive=True).select("instr", "d", F.round("later", 4).alias("later"))


@add("g26_roll_summary", f"WITH {ROLLS} SELECT instr, count(*) AS rolls, round(sum(coalesce(gap, 0)), 4) AS total FROM ev GROUP BY instr")
def roll_summary(m: Market) -> DataFrame:
    return roll_events(m).groupBy("instr").agg(F.count("*").alias("rolls"), F.round(F.sum(F.coalesce("gap", F.lit(0.0))), 4).alias("total"))


@add("f8_contract_dates", """
WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), x AS (SELECT d, CAST(d + INTERVAL 9 DAY AS DATE) AS tenth, last_day(d) AS le, last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) AS pe FROM m)
SELECT d, CAST(d + ((9 - isodow(d)) % 7 + 14)::INTEGER AS DATE) AS third_tuesday, CAST(le - greatest(isodow(le) - 5, 0)::INTEGER AS DATE) AS last_weekday, CAST(pe - greatest(isodow(pe) - 5, 0)::INTEGER AS DATE) AS first_notice,
 CASE isodow(tenth) WHEN 6 THEN CAST(tenth + 2 - 4 AS DATE) WHEN 7 THEN CAST(tenth + 1 - 4 AS DATE) WHEN 1 THEN CAST(tenth - 4 AS DATE) WHEN 2 THEN CAST(tenth - 4 AS DATE) ELSE CAST(tenth - 2 AS DATE) END AS last_trading FROM x""")
def contract_dates(m: Market) -> DataFrame:
    d = m.table("orders").select(F.to_date(F.trunc("o_orderdate", "MM")).alias("d")).distinct()
    day = F.col("d")
    return d.select("d", c.third_tuesday(day).alias("third_tuesday"), c.last_weekday(day).alias("last_weekday"), c.first_notice(day).alias("first_notice"), c.last_trading(day).alias("last_trading"))


@add("f12_weekday_counts", """
SELECT o_orderkey, (SELECT count(*) FROM range(0, 30) r(i) WHERE i < o_orderkey % 30 AND isodow(CAST(o_orderdate AS DATE) + 1 + i::INTEGER) < 6) AS ahead FROM orders""")
def weekday_counts(m: Market) -> DataFrame:
    d = F.to_date("o_orderdate")
    end = F.date_add(d, (F.col("o_orderkey") % 30).cast("int"))
    return m.table("orders").select("o_orderkey", c.weekdays_between(d, end).cast("long").alias("ahead"))


@add("f6_contract_codes", """
WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), q AS (SELECT d, CAST(date_trunc('month', d + INTERVAL 1 MONTH * (3 - month(d) % 3)) AS DATE) AS n FROM m)
SELECT d, n AS next_quarter, 'ZN' || CASE month(n) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || strftime(n, '%y') AS us, 'A65' || (year(n) % 10) || substr('123456789ABC', month(n), 1) || '000' AS kr FROM q""")
def contract_codes(m: Market) -> DataFrame:
    d = m.table("orders").select(F.to_date(F.trunc("o_orderdate", "MM")).alias("d")).distinct().withColumn("next_quarter", c.next_quarter(F.col("d")))
    return d.select("d", "next_quarter", c.us_code(F.lit("ZN"), F.col("next_quarter")).alias("us"), c.krx_code(F.lit("65"), F.col("next_quarter")).alias("kr"))


def roll_sql(volumes: str, code: str, after: str, expiry: str, by_volume: str) -> str:
    """Decisions for each order day; m is the month of the held contract, n that of the next."""
    return f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS "asof"{volumes} FROM orders GROUP BY ALL), m AS (SELECT *, CAST(date_trunc('quarter', "asof") + INTERVAL 2 MONTH AS DATE) AS m, CAST(date_trunc('quarter', "asof") + INTERVAL 5 MONTH AS DATE) AS n, last_day(CAST(date_trunc('quarter', "asof") + INTERVAL 1 MONTH AS DATE)) AS pe FROM a),
x AS (SELECT *, {code} AS code, {after} AS next_code, {expiry} AS expiry FROM m), y AS (SELECT *, (SELECT count(*) FROM range(0, 130) r(i) WHERE "asof" + 1 + i::INTEGER <= expiry AND isodow("asof" + 1 + i::INTEGER) < 6) - (SELECT count(*) FROM range(0, 130) r(i) WHERE expiry + 1 + i::INTEGER <= "asof" AND isodow(expiry + 1 + i::INTEGER) < 6) AS days FROM x),
z AS (SELECT *, CASE WHEN {by_volume} THEN 'volume' WHEN days <= 5 THEN 'calendar' ELSE 'none' END AS reason FROM y)
SELECT * EXCLUDE (m, n, pe, days), CAST(days AS INTEGER) AS "left", reason <> 'none' AS roll FROM z"""


US = "'ZN' || CASE month({0}) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || strftime({0}, '%y')"
KR = "'A65' || (year({0}) % 10) || substr('123456789ABC', month({0}), 1) || '000'"


@add("g25_roll_decision", roll_sql(", CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS vol_now, CAST(sum(CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS vol_next",
     KR.format("m"), KR.format("n"), "CAST(m + ((9 - isodow(m)) % 7 + 14)::INTEGER AS DATE)", "vol_next > vol_now"))
def roll_decision(m: Market) -> DataFrame:
    days = m.table("orders").groupBy(F.to_date("o_orderdate").alias("asof")).agg(
        F.sum(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)).alias("vol_now"), F.sum(F.when(F.col("o_orderkey") % 2 == 1, 1).otherwise(0)).alias("vol_next"))
    held = days.withColumn("code", c.krx_code(F.lit("65"), F.add_months(F.trunc("asof", "quarter"), 2)))
    return roll.decide(held, "KRX")


@add("w22_front_month", "SELECT o_orderpriority AS product, arg_min(o_orderkey, (year(o_orderdate), month(o_orderdate), o_orderkey)) AS front FROM orders GROUP BY 1")
def front_month(m: Market) -> DataFrame:
    return m.table("orders").groupBy(F.col("o_orderpriority").alias("product")).agg(F.min_by("o_orderkey", F.struct(F.year("o_orderdate"), F.month("o_orderdate"), "o_orderkey")).alias("front"))


@add("x_status", "SELECT instr, count(*) AS n, max(t) AS last_t, arg_max(close, t) AS last, date_diff('minute', max(t), (SELECT max(t) FROM bars)) AS age FROM bars GROUP BY instr")
def status(m: Market) -> DataFrame:
    asof = m.bars.agg(F.max("t").alias("asof"))
    last = m.bars.groupBy("instr").agg(F.count("*").alias("n"), F.max("t").alias("last_t"), F.max_by("close", "t").alias("last"))
    return last.join(F.broadcast(asof)).select("instr", "n", "last_t", "last", F.timestamp_diff("MINUTE", F.col("last_t"), F.col("asof")).alias("age"))


@add("x_spread_view", "SELECT t, round(s, 6) AS s FROM (SELECT t, a_close - b_close AS s FROM aligned WHERE pair = 'click-view' ORDER BY t DESC LIMIT 300)")
def spread_view(m: Market) -> DataFrame:
    return m.aligned.where("pair = 'click-view'").orderBy(F.desc("t")).limit(300).select("t", r6(F.col("a_close") - F.col("b_close")).alias("s"))
