"""What comes from outside and goes there: drops, settings, reports, logs, timed batches, calendars, the daily chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import calendar
from spreadloom.functions import columns as c
from spreadloom.functions.columns import r6
from spreadloom.operators import bootstrap
from spreadloom.plans.chain import Chain
from spreadloom.plans.market import Catalog, Market
from spreadloom.plans.surface import scratch
from spreadloom.sources import files
from spreadloom.sources.store import KeyedStore
from spreadloom.streaming import live

catalog = Catalog()
add = catalog.add


@add("s7_bar_drop", "SELECT instr, t, open, high, low, close, volume FROM bars WHERE hour(t) NOT IN (3, 4)")
def bar_drop(m: Market) -> DataFrame:
    """The bars as a vendor drops them, all text and times without leading zeros; some closes are no numbers, some not positive."""
    folder = scratch(m.spark)
    close = F.when(F.hour("t") == 3, "n/a").when(F.hour("t") == 4, "-0.0").otherwise(F.col("close").cast("string"))
    time = F.date_format("t", "HHmmss").cast("int").cast("string")
    m.bars.select("instr", F.date_format("t", "yyyyMMdd").alias("date"), time.alias("time"), *[F.col(x).cast("string").alias(x) for x in ("open", "high", "low")], close.alias("close"), F.col("volume").cast("string").alias("volume")).write.json(f"{folder}/drop")
    return files.bar_drop(m.spark, f"{folder}/drop")


@add("s14_settings", """SELECT 'found' AS source, 'bars' AS name, CAST(count(*) AS VARCHAR) AS value FROM bars UNION ALL
SELECT * FROM (VALUES ('found', 'window', '120'), ('found', 'threshold', '2.0'), ('none', 'bars', '0'), ('none', 'window', '120'), ('none', 'threshold', '2.0')) v(source, name, value)""")
def settings(m: Market) -> DataFrame:
    """Settings of a file over defaults, where null settings count as absent, and defaults alone where there is no file."""
    folder, defaults = scratch(m.spark), {"bars": "0", "window": "120", "threshold": "2.0"}
    m.bars.agg(F.count("*").cast("string").alias("bars"), F.lit(None).cast("string").alias("window")).coalesce(1).write.option("ignoreNullFields", False).json(f"{folder}/settings")
    got = {"found": files.settings(m.spark, f"{folder}/settings", defaults), "none": files.settings(m.spark, f"{folder}/nothing", defaults)}
    return m.spark.createDataFrame([(s, k, v) for s, d in got.items() for k, v in d.items()], "source string, name string, value string")


REPORT = "SELECT instr, count(*) AS n, arg_max(close, t) AS last, CAST(count(DISTINCT CAST(t AS DATE)) AS INTEGER) AS days FROM bars GROUP BY instr"


def nested(m: Market) -> DataFrame:
    return m.bars.groupBy("instr").agg(F.struct(F.count("*").alias("n"), F.max_by("close", "t").alias("last")).alias("stats"), F.array_sort(F.collect_set(F.to_date("t").cast("string"))).alias("days"))


@add("s15_nested_reports", REPORT)
def nested_reports(m: Market) -> DataFrame:
    """A nested report per instrument, each a file of its own, read back."""
    folder = scratch(m.spark)
    nested(m).select(F.col("instr").alias("part"), F.to_json(F.struct("instr", "stats", "days")).alias("value")).repartition("part").write.partitionBy("part").text(f"{folder}/reports")
    return files.reports(m.spark, f"{folder}/reports").select("instr", "stats.n", "stats.last", F.size("days").alias("days"))


@add("k13_order_log", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS ref_price FROM orders")
def order_log(m: Market) -> DataFrame:
    """Dry orders appended to a log in two runs."""
    folder = scratch(m.spark)
    rows = m.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("ref_price"))
    for part in (0, 1):
        files.append_orders(rows.where(F.col("o_orderkey") % 2 == part), f"{folder}/log")
    return m.spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/log")


@add("k15_replaced_report", REPORT)
def replaced_report(m: Market) -> DataFrame:
    """A report that a later one replaces."""
    folder = scratch(m.spark)
    rows = nested(m).select("instr", "stats.n", "stats.last", F.size("days").alias("days"))
    for df in (rows.withColumn("n", F.lit(-1).cast("long")), rows):
        files.json_report(df, f"{folder}/report")
    return m.spark.read.schema(rows.schema).json(f"{folder}/report")


@add("k16_daily_log", "SELECT instr, CAST(t AS DATE) AS day, strftime(min(t), '%Y-%m-%d %H:%M') AS closed, arg_min(close, t) AS close FROM bars WHERE hour(t) >= 15 GROUP BY ALL")
def daily_log(m: Market) -> DataFrame:
    """A closing record per instrument and day, the first from 15:00 on, appended in three runs of which two overlap."""
    folder = scratch(m.spark)
    rows = m.bars.select("instr", F.to_date("t").alias("day"), F.col("t").alias("asof"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("closed"), "close")
    for part in (F.dayofmonth("day") < 12, F.dayofmonth("day") < 20, F.lit(True)):
        files.append_daily(m.spark, rows.where(part), f"{folder}/log", ["instr", "day"], "asof")
    return m.spark.read.schema("instr string, day date, closed string, close double").json(f"{folder}/log")


@add("s10_market_feed", """SELECT instr, CAST(date_trunc('day', t) AS DATE) AS day, CASE WHEN instr IN ('click', 'error') THEN 'abroad' ELSE 'home' END AS market, count(*) AS n, max(px) AS high, min(px) AS low,
 coalesce(sum(CASE WHEN instr NOT IN ('click', 'error') THEN qty END), 0) AS volume, max(CASE WHEN instr IN ('click', 'error') THEN event_id END)::DOUBLE AS counter FROM ticks GROUP BY ALL""")
def market_feed(m: Market) -> DataFrame:
    """Daily figures of the trades of two markets, read from one stream of messages in their two forms."""
    folder = scratch(m.spark)
    day, time = F.date_format("t", "yyyyMMdd"), F.date_format("t", "HHmmss").cast("int").cast("string")
    text = lambda c: F.col(c).cast("string")
    home = F.to_json(F.struct(F.rpad("instr", 8, " ").alias("futcode"), text("px").alias("price"), time.alias("chetime"), text("qty").alias("cvolume")))
    abroad = F.to_json(F.struct(F.rpad("instr", 8, " ").alias("symbol"), text("px").alias("curpr"), day.alias("kordate"), time.alias("kortm"), text("event_id").alias("totq")))
    broken = F.to_json(F.struct(F.lit("view").alias("futcode"), F.lit("n/a").alias("price"), time.alias("chetime")))
    sent = F.when(F.col("instr").isin("click", "error"), F.array(abroad)).otherwise(F.array(home, broken))
    messages = m.ticks.select(F.explode(sent).alias("value"), F.to_date("t").alias("day"))
    messages.write.parquet(f"{folder}/in")
    ticks = live.market_ticks(live.ticks_from(m.spark, f"{folder}/in", messages.schema, files=64))
    live.run_available(ticks, f"{folder}/check", each=lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"))
    return m.spark.read.parquet(f"{folder}/out").groupBy("instr", F.to_date("t").alias("day")).agg(
        F.max(F.when(F.col("totq").isNotNull(), "abroad").otherwise("home")).alias("market"), F.count("*").alias("n"), F.max("px").alias("high"), F.min("px").alias("low"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("volume"), F.max("totq").alias("counter"))


@add("x10_timed_batches", "SELECT instr, count(*) AS n, max(px) AS high FROM ticks GROUP BY instr")
def timed_batches(m: Market) -> DataFrame:
    """Counts that a batch every second brings up to date in a keyed store."""
    folder = scratch(m.spark)
    events = m.spark.readStream.schema(m.table("events").schema).option("maxFilesPerTrigger", 4).parquet(f"{m.dir}/events.parque[t]")
    counts = events.where("value > 0").groupBy(F.col("event_type").alias("instr")).agg(F.count("*").alias("n"), F.max("value").alias("high"))
    live.run_periodic(counts, f"{folder}/check", "1 second", live.keyed_sink(f"{folder}/counts", ["instr"], 4), "update")
    return KeyedStore(m.spark, f"{folder}/counts", ["instr"]).read()


@add("f13_contract_table", """
WITH o AS (SELECT CAST(date_trunc('month', o_orderdate + INTERVAL 1 MONTH * (3 - month(o_orderdate) % 3)) AS DATE) AS d, count(*) AS orders FROM (SELECT date_trunc('month', o_orderdate) AS o_orderdate FROM orders) GROUP BY ALL),
x AS (SELECT *, CAST(d + INTERVAL 9 DAY AS DATE) AS tenth, last_day(d) AS le, last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) AS pe FROM o),
k AS (SELECT *, 'ZN' || CASE month(d) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || strftime(d, '%y') AS us, 'A65' || (year(d) % 10) || substr('123456789ABC', month(d), 1) || '000' AS kr FROM x)
SELECT code, d AS "month", CAST(d + ((9 - isodow(d)) % 7 + 14)::INTEGER AS DATE) AS third_tuesday, CAST(le - greatest(isodow(le) - 5, 0)::INTEGER AS DATE) AS last_weekday, CAST(pe - greatest(isodow(pe) - 5, 0)::INTEGER AS DATE) AS first_notice,
 CASE isodow(tenth) WHEN 6 THEN CAST(tenth + 2 - 4 AS DATE) WHEN 7 THEN CAST(tenth + 1 - 4 AS DATE) WHEN 1 THEN CAST(tenth - 4 AS DATE) WHEN 2 THEN CAST(tenth - 4 AS DATE) ELSE CAST(tenth - 2 AS DATE) END AS last_trading, orders
FROM (SELECT us AS code, * FROM k UNION ALL SELECT kr, * FROM k)""")
def contract_table(m: Market) -> DataFrame:
    """All contracts of two roots over the span of the orders, from the table function, with the orders that precede each."""
    orders = m.table("orders").select(c.next_quarter(F.to_date("o_orderdate")).alias("month")).groupBy("month").agg(F.count("*").alias("orders"))
    m.spark.udtf.register("contracts", calendar.Contracts)
    roots = m.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.add_months(F.to_date(F.max("o_orderdate")), 3).alias("last")).select("*", F.explode(F.array(F.lit("ZN"), F.lit("65"))).alias("root"))
    roots.createOrReplaceTempView("roots_")
    found = m.spark.sql("SELECT c.* FROM roots_ r, LATERAL contracts(r.root, r.first, r.last) c")
    return found.join(orders, "month")


BLOCK, SEEDS, HORIZONS = 24, 200, (1, 2, 4, 8)


@add("g17_bootstrap_ladder", f"""
WITH h AS (SELECT unnest([1, 2, 4, 8]) AS h), q AS (SELECT pair, h, t, s AS x, lead(s, h) OVER (PARTITION BY pair, h ORDER BY t) - s AS y FROM spread, h),
r AS (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY pair, h) AS n FROM q WHERE y IS NOT NULL WINDOW o AS (PARTITION BY pair, h ORDER BY t)),
b AS (SELECT pair, h, k, n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy FROM r WINDOW w AS (PARTITION BY pair, h ORDER BY t ROWS BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING)),
z AS (SELECT DISTINCT pair, h, n FROM b WHERE n >= {BLOCK}), d AS (SELECT pair, h, n, seed, unnest(range(0, CAST(ceil(n / {BLOCK}.0) AS BIGINT))) AS draw FROM (SELECT *, unnest(range(1, {SEEDS + 1})) AS seed FROM z)),
p AS (SELECT pair, h, seed, ((seed * {bootstrap.BY_SEED} + draw * {bootstrap.BY_DRAW} + 1) * {bootstrap.SPREAD} % {bootstrap.MODULUS}) % (n - {BLOCK} + 1) AS k FROM d),
g AS (SELECT p.pair, p.h, seed, {BLOCK}.0 * count(*) AS c, sum(sx) AS x, sum(sy) AS y, sum(sxx) AS xx, sum(sxy) AS xy FROM p JOIN b ON b.pair = p.pair AND b.h = p.h AND b.k = p.k GROUP BY ALL),
s AS (SELECT pair, h, (xy - x * y / c) / (xx - x * x / c) AS slope FROM g), f AS (SELECT pair, h, count(*) AS n, regr_slope(y, x) AS gamma FROM r GROUP BY ALL)
SELECT f.pair, CAST(f.h AS INTEGER) AS horizon, any_value(f.n) AS n, round(any_value(gamma), 5) AS gamma, round(quantile_cont(slope, 0.05), 5) AS low, round(quantile_cont(slope, 0.95), 5) AS high FROM f JOIN s ON f.pair = s.pair AND f.h = s.h GROUP BY ALL""")
def bootstrap_ladder(m: Market) -> DataFrame:
    """Reversion of spreads over overlapping horizons, with an interval of moving-block replicates per pair and horizon."""
    w = Window.partitionBy("pair").orderBy("t")
    ladder = reduce(DataFrame.unionByName, [m.spread.select("pair", F.lit(h).alias("horizon"), "t", F.col("s").alias("x"), (F.lead("s", h).over(w) - F.col("s")).alias("y")) for h in HORIZONS]).where("y is not null")
    keys = ["pair", "horizon"]
    fit = ladder.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 5).alias("gamma"))
    spread = bootstrap.slopes(ladder, keys, "t", "x", "y", BLOCK, SEEDS).groupBy(*keys).agg(*[F.round(F.percentile("slope", p), 5).alias(name) for p, name in ((0.05, "low"), (0.95, "high"))])
    return fit.join(spread, keys)


@add("x_daily_chain", """
WITH days AS (SELECT DISTINCT CAST(t AS DATE) AS day FROM bars ORDER BY 1 DESC LIMIT 3), b AS (SELECT instr, t, close, CAST(t AS DATE) AS d, hour(t) % 5 <> 4 AS early FROM bars WHERE CAST(t AS DATE) IN (SELECT day FROM days)),
p AS (SELECT day, x.instr || '-' || y.instr AS pair, x.t, x.close - y.close AS s, x.d = day AS today, x.early FROM days JOIN b x ON x.d <= day JOIN b y ON x.t = y.t AND x.instr < y.instr),
r AS (SELECT p.day, pair, count(*) AS n, count(*) FILTER (t IN (SELECT date_trunc('hour', t) FROM fx)) AS rated FROM p GROUP BY ALL),
e AS (SELECT day, pair, round(arg_max(s, t), 6) AS last, round((arg_max(s, t) - avg(s)) / stddev_pop(s), 5) AS z FROM p WHERE early OR NOT today GROUP BY ALL)
SELECT r.day, r.pair, n, rated, n >= 20 AS ready, last, z FROM r LEFT JOIN e ON r.day = e.day AND r.pair = e.pair""")
def daily_chain(m: Market) -> DataFrame:
    """The latest three days by the chain; the first breaks off behind each of its stages and goes on, and all are run twice."""
    chain = Chain(m, f"{scratch(m.spark)}/chain")
    days = sorted(r[0] for r in m.bars.select(F.to_date("t").alias("day")).distinct().orderBy(F.desc("day")).limit(3).collect())
    for stage in Chain.STAGES:
        chain.run(days[0], stop_after=stage)
    for day in days * 2:
        chain.run(day)
    return chain.report()
