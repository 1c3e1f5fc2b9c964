"""Queries over bars, joins by time, sessions and statistics, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.functions.columns import r6
from spreadloom.operators import align, bars, scans, sessions, stats
from spreadloom.plans.market import Catalog, Market

catalog = Catalog()
add = catalog.add


@add("s1_series_scan", "SELECT t, close FROM bars WHERE instr = 'click' AND close > 0")
def series_scan(m: Market) -> DataFrame:
    return m.bars.where("instr = 'click' and close > 0").select("t", "close")


@add("s2_tail_scan", "SELECT instr, t, close FROM (SELECT *, row_number() OVER (PARTITION BY instr ORDER BY t DESC) AS k FROM bars) WHERE k <= 60")
def tail_scan(m: Market) -> DataFrame:
    return stats.tail(m.bars, ["instr"], "t", 60).select("instr", "t", "close")


@add("s6_instrument_scan", "SELECT s.instr, s.point, s.rank, min(b.t) AS first_t, count(b.t) AS n FROM spec s LEFT JOIN bars b ON s.instr = b.instr WHERE s.ccy = 'USD' GROUP BY ALL")
def instrument_scan(m: Market) -> DataFrame:
    some = m.spec.where("ccy = 'USD'")
    return some.join(m.bars, "instr", "left").groupBy("instr", "point", "rank").agg(F.min("t").alias("first_t"), F.count("t").alias("n"))


@add("s13_spot_fallback", """
WITH main AS (SELECT instr, t, open, high, low, close, volume FROM bars WHERE instr <> 'view'),
spot AS (SELECT instr, max(t) AS t, arg_max(px, t) AS px FROM ticks GROUP BY instr)
SELECT * FROM main UNION ALL SELECT instr, t, px, px, px, px, 0.0::DOUBLE FROM spot WHERE instr NOT IN (SELECT instr FROM main)""")
def spot_fallback(m: Market) -> DataFrame:
    spot = m.ticks.groupBy("instr").agg(F.max_by("px", "t").alias("px"), F.max("t").alias("t")).select("instr", "t", "px")
    return bars.spot_fallback(m.bars.where("instr <> 'view'"), spot)


@add("a3_tick_bars", "SELECT instr, t, open, high, low, close, volume, n FROM bars")
def tick_bars(m: Market) -> DataFrame:
    return m.bars


COUNTER_BARS = """
WITH c AS (SELECT *, (event_id * 7 % 1000)::DOUBLE AS totq FROM ticks),
d AS (SELECT *, lag(totq) OVER (PARTITION BY instr ORDER BY t) AS p FROM c),
q AS (SELECT instr, t, px, CASE WHEN p IS NULL THEN 0 WHEN totq < p THEN totq ELSE totq - p END AS step FROM d)
SELECT instr, time_bucket(INTERVAL '1 hour', t) AS t, arg_max(px, t) AS close, CAST(sum(step) AS DOUBLE) AS volume FROM q GROUP BY ALL"""


@add("a4_counter_bars", COUNTER_BARS)
def counter_bars(m: Market) -> DataFrame:
    sized = bars.counter_sizes(m.ticks.withColumn("totq", (F.col("event_id") * 7 % 1000).cast("double")), "totq")
    return bars.tick_bars(sized, f"{m.scale.bar} minutes").select("instr", "t", "close", "volume")


@add("a5_monthly_closes", "SELECT instr, CAST(date_trunc('month', d) AS DATE) AS d, arg_max(close, d) AS close, sum(volume) AS volume FROM daily GROUP BY ALL")
def monthly_closes(m: Market) -> DataFrame:
    return bars.calendar_closes(m.daily, "MM")


@add("a5_iso_week_closes", "SELECT instr, CAST(isoyear(d) AS INTEGER) AS year, CAST(weekofyear(d) AS INTEGER) AS week, arg_max(close, d) AS close FROM daily GROUP BY ALL")
def week_closes(m: Market) -> DataFrame:
    return bars.iso_week(m.daily)


@add("a6_resample", """
SELECT instr, time_bucket(INTERVAL '240 minutes', t) AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, sum(volume) AS volume
FROM bars GROUP BY ALL""")
def resample(m: Market) -> DataFrame:
    return bars.resampled(m.bars, 4 * m.scale.bar)


@add("a6_resample_hour_floor", """
WITH b AS (SELECT *, date_trunc('hour', t) + INTERVAL 1 MINUTE * (minute(t) // 15 * 15) AS bucket FROM (SELECT instr, time_bucket(INTERVAL '5 minutes', t) AS t, arg_min(px, t) AS open, arg_max(px, t) AS close FROM ticks GROUP BY ALL))
SELECT instr, bucket AS t, arg_min(open, t) AS open, arg_max(close, t) AS close FROM b GROUP BY ALL""")
def resample_hour_floor(m: Market) -> DataFrame:
    return bars.resampled(bars.tick_bars(m.ticks, "5 minutes"), 15, hour_floor=True).select("instr", "t", "open", "close")


@add("j1_pair_alignment", "SELECT pair, a, b, t, a_open, a_close, b_open, b_close FROM aligned")
def pair_alignment(m: Market) -> DataFrame:
    return m.aligned


@add("j3_three_way_count", "SELECT pair, count(*) AS n FROM aligned x JOIN bars f ON x.t = f.t AND f.instr = 'purchase' GROUP BY pair")
def three_way(m: Market) -> DataFrame:
    fx = m.bars.where("instr = 'purchase'").select("t")
    return m.aligned.join(fx, "t").groupBy("pair").agg(F.count("*").alias("n"))


@add("j4_asof_backward", """
SELECT x.pair, x.t, x.a_close, f.rate, f.t AS rate_t FROM aligned x ASOF JOIN fx f ON x.t >= f.t """)
def asof_backward(m: Market) -> DataFrame:
    return scans.carried(m.aligned.select("pair", "t", "a_close"), m.fx, [], "rate").select("pair", "t", "a_close", "rate", "rate_t").where("rate is not null")


@add("j5_carry_forward_rate", """
WITH f AS (SELECT t, close AS rate FROM bars WHERE instr = 'purchase')
SELECT pair, x.t, a_close, last_value(rate IGNORE NULLS) OVER (PARTITION BY pair ORDER BY x.t ROWS UNBOUNDED PRECEDING) AS rate FROM aligned x LEFT JOIN f ON x.t = f.t""")
def carry_forward(m: Market) -> DataFrame:
    rates = m.bars.where("instr = 'purchase'").select("t", F.col("close").alias("rate"))
    return align.last_seen(m.aligned.select("pair", "t", "a_close"), rates, ["pair"], "rate").select("pair", "t", "a_close", "rate")


@add("j6_semi_join", "SELECT instr, count(*) AS n FROM bars WHERE instr IN (SELECT instr FROM spec WHERE ccy = 'KRW') GROUP BY instr")
def semi_join(m: Market) -> DataFrame:
    return m.bars.join(m.spec.where("ccy = 'KRW'"), "instr", "left_semi").groupBy("instr").agg(F.count("*").alias("n"))


@add("j7_last_bar_per_instrument", "SELECT s.instr, (SELECT max(t) FROM bars b WHERE b.instr = s.instr AND b.close > 250) AS last_t FROM spec s")
def last_bar(m: Market) -> DataFrame:
    last = m.bars.where("close > 250").groupBy("instr").agg(F.max("t").alias("last_t"))
    return m.spec.select("instr").join(last, "instr", "left")


@add("j8_anti_join", "SELECT a.t, a.close FROM bars a WHERE a.instr = 'click' AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.instr = 'view' AND b.t = a.t)")
def anti_join(m: Market) -> DataFrame:
    there = m.bars.where("instr = 'view'").select("t")
    return m.bars.where("instr = 'click'").join(there, "t", "left_anti").select("t", "close")


@add("j9_overlap_comparison", """
WITH d AS (SELECT pair, abs(a_close - b_close) AS x FROM aligned), l AS (SELECT pair, list_sort(list(x)) AS v, max(x) AS worst FROM d GROUP BY pair)
SELECT pair, CAST(len(v) AS INTEGER) AS n, v[len(v) // 2 + 1] AS median, worst, worst > 0.05 AS blocked FROM l""")
def overlap_comparison(m: Market) -> DataFrame:
    x = m.aligned.select("pair", F.abs(F.col("a_close") - F.col("b_close")).alias("x"))
    out = stats.ranked(x, "pair", "x", {"median": lambda n: F.floor(n / 2), "worst": lambda n: n - 1})
    return out.select("pair", F.col("n").cast("int").alias("n"), "median", "worst", (F.col("worst") > 0.05).alias("blocked"))


HOLES = """h AS (SELECT instr, t0 + INTERVAL '60 minutes' AS gap_from, t - INTERVAL '60 minutes' AS gap_to, date_diff('minute', t0, t) - 60 AS minutes FROM
 (SELECT instr, t, lag(t) OVER (PARTITION BY instr ORDER BY t) AS t0 FROM bars) WHERE date_diff('minute', t0, t) > 60)"""
ISLANDS = """sp AS (SELECT ts - INTERVAL '6 hours' AS lo, ts + INTERVAL '6 hours' AS hi FROM log),
f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp),
g AS (SELECT lo, hi, sum(new) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f), u AS (SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY island)"""


@add("w20_holes", f"WITH {HOLES} SELECT instr, gap_from, gap_to, minutes FROM h")
def holes(m: Market) -> DataFrame:
    return sessions.holes(m.bars, ["instr"], "t", m.scale.bar)


@add("w21_uptime_windows", f"WITH {ISLANDS} SELECT lo, hi FROM u")
def uptime(m: Market) -> DataFrame:
    return sessions.merged(m.log, "ts", 6 * m.scale.bar)


@add("j10_hole_in_uptime", f"WITH {HOLES}, {ISLANDS} SELECT instr, gap_from, gap_to, minutes, EXISTS (SELECT 1 FROM u WHERE u.lo <= h.gap_from AND h.gap_to <= u.hi) AS covered FROM h")
def hole_in_uptime(m: Market) -> DataFrame:
    return sessions.inside(holes(m), uptime(m), "gap_from", "gap_to")


@add("j11_pairs_with_overlap", "SELECT pair, count(*) AS n FROM aligned GROUP BY pair HAVING count(*) >= 200")
def pairs_with_overlap(m: Market) -> DataFrame:
    return align.enough(m.aligned, 200)


@add("j14_asof_forward", """
WITH q AS (SELECT instr, t, close FROM bars), x AS (SELECT instr, t, t + INTERVAL '3 hours' AS due, close FROM bars)
SELECT x.instr, x.t, x.close, q.close AS later FROM x ASOF JOIN q ON x.instr = q.instr AND x.due <= q.t""")
def asof_forward(m: Market) -> DataFrame:
    due = m.bars.select("instr", sessions.after(F.col("t"), 3 * m.scale.bar).alias("t"), F.col("t").alias("from"), "close")
    later = m.bars.select("instr", "t", F.col("close").alias("later"))
    out = align.carried(due, later, ["instr"], "later", forward=True).where("later is not null")
    return out.select("instr", F.col("from").alias("t"), "close", "later")


@add("j15_time_grid", """
WITH g AS (SELECT t, max(close) FILTER (instr = 'click') AS click, max(close) FILTER (instr = 'view') AS "view" FROM bars WHERE instr IN ('click', 'view') GROUP BY t)
SELECT t, click, "view" FROM g ORDER BY t DESC LIMIT 600""")
def time_grid(m: Market) -> DataFrame:
    return align.on_grid(m.bars, ["click", "view"], 600)


@add("j16_pivot_align", """
SELECT t, avg(close) FILTER (instr = 'click') AS click, avg(close) FILTER (instr = 'error') AS error, avg(close) FILTER (instr = 'view') AS "view"
FROM bars GROUP BY t HAVING count(DISTINCT instr) FILTER (instr IN ('click', 'error', 'view')) = 3""")
def pivot_align(m: Market) -> DataFrame:
    return align.pivoted(m.bars, ["click", "error", "view"])


@add("a1_grouped_counts", "SELECT instr, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM bars GROUP BY instr")
def grouped_counts(m: Market) -> DataFrame:
    return m.bars.groupBy("instr").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@add("a2_global_counts", "SELECT count(*) AS n, count(DISTINCT instr) AS instruments, min(t) AS first_t, max(t) AS last_t FROM bars")
def global_counts(m: Market) -> DataFrame:
    return m.bars.agg(F.count("*").alias("n"), F.count_distinct("instr").alias("instruments"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@add("w1_sessionize", "SELECT pair, t, sid FROM pair_bars")
def sessionize(m: Market) -> DataFrame:
    return scans.sessionize(m.aligned, ["pair"], "t", m.scale.gap).select("pair", "t", "sid")


@add("w2_consecutive_steps", "SELECT pair, sid, t, round(x, 6) AS x, round(d, 6) AS d FROM steps")
def consecutive(m: Market) -> DataFrame:
    return m.steps.select("pair", "sid", "t", r6("x").alias("x"), r6("d").alias("d"))


@add("w13_longest_session", """
SELECT pair, sid, n, first, last FROM (SELECT pair, sid, count(*) AS n, min(t) AS first, max(t) AS last, row_number() OVER (PARTITION BY pair ORDER BY count(*) DESC, sid) AS k FROM pair_bars GROUP BY pair, sid) WHERE k = 1""")
def longest_session(m: Market) -> DataFrame:
    return sessions.session_table(m.pair_bars, "pair").where("rank = 1").drop("rank")


@add("w14_last_non_null", "SELECT pair, arg_max(d, t) FILTER (d > 0) AS last_rise FROM steps GROUP BY pair")
def last_non_null(m: Market) -> DataFrame:
    return m.steps.groupBy("pair").agg(F.max_by(F.when(F.col("d") > 0, F.col("d")), F.when(F.col("d") > 0, F.col("t"))).alias("last_rise"))


@add("w23_last_close", "SELECT instr, max(t) AS t, arg_max(close, t) AS close FROM bars GROUP BY instr")
def last_close(m: Market) -> DataFrame:
    return m.bars.groupBy("instr").agg(F.max_by("close", "t").alias("close"), F.max("t").alias("t"))


@add("p1_spread_difference", "SELECT pair, t, round(a_close - b_close, 6) AS s FROM aligned")
def spread_difference(m: Market) -> DataFrame:
    return m.aligned.select("pair", "t", r6(F.col("a_close") - F.col("b_close")).alias("s"))


@add("p2_log_spread", "SELECT pair, t, round(100 * (ln(a_close) - ln(b_close)), 6) AS s FROM aligned")
def log_spread(m: Market) -> DataFrame:
    return m.aligned.select("pair", "t", r6(100 * (F.ln("a_close") - F.ln("b_close"))).alias("s"))


@add("p3_beta_log_spread", """
WITH f AS (SELECT pair, regr_slope(ln(a_close), ln(b_close)) AS beta FROM aligned GROUP BY pair)
SELECT x.pair, x.t, round(ln(a_close) - beta * ln(b_close), 6) AS s FROM aligned x JOIN f ON x.pair = f.pair""")
def beta_log_spread(m: Market) -> DataFrame:
    logs = m.aligned.select("pair", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    fit = stats.ols(logs, "pair", "lb", "la").select("pair", "b")
    return logs.join(fit, "pair").select("pair", "t", r6(F.col("la") - F.col("b") * F.col("lb")).alias("s"))


HEDGED = """v AS (SELECT x.pair, x.t, sa.point * x.a_close * CASE sa.ccy WHEN 'USD' THEN f.rate ELSE 1 END AS va, sb.point * x.b_close * CASE sb.ccy WHEN 'USD' THEN f.rate ELSE 1 END AS vb, f.rate
 FROM aligned x JOIN spec sa ON x.a = sa.instr JOIN spec sb ON x.b = sb.instr ASOF JOIN fx f ON x.t >= f.t)"""


def contract_values(m: Market) -> DataFrame:
    """Legs in one currency: contract value, times the last rate for those in another."""
    pairs = m.aligned
    rows = scans.carried(pairs.select("pair", "t", "a", "b", "a_close", "b_close"), m.fx, [], "rate").where("rate is not null")
    spec = F.broadcast(m.spec.select("instr", "point", "ccy"))
    for side in "ab":
        leg = spec.select(F.col("instr").alias(side), F.col("point").alias(f"{side}_point"), F.col("ccy").alias(f"{side}_ccy"))
        rows = rows.join(leg, side)
    value = lambda s: F.col(f"{s}_point") * F.col(f"{s}_close") * F.when(F.col(f"{s}_ccy") == "USD", F.col("rate")).otherwise(1.0)
    return rows.select("pair", "t", value("a").alias("va"), value("b").alias("vb"), "rate")


@add("p5_contract_values", f"WITH {HEDGED} SELECT pair, t, round(va, 4) AS va, round(vb, 4) AS vb FROM v")
def values(m: Market) -> DataFrame:
    return contract_values(m).select("pair", "t", F.round("va", 4).alias("va"), F.round("vb", 4).alias("vb"))


@add("p6_hedged_spread", f"WITH {HEDGED}, f AS (SELECT pair, regr_slope(va, vb) AS b, regr_r2(va, vb) AS r2 FROM v GROUP BY pair) SELECT v.pair, count(*) AS n, round(min(b), 6) AS b, round(min(r2), 6) AS r2, round(avg((va - b * vb) / 1e6), 4) AS mean FROM v JOIN f ON v.pair = f.pair GROUP BY v.pair")
def hedged(m: Market) -> DataFrame:
    v = contract_values(m)
    fit = stats.ols(v, "pair", "vb", "va").select("pair", "b", "r2")
    out = v.join(fit, "pair").groupBy("pair").agg(F.count("*").alias("n"), r6(F.min("b")).alias("b"), r6(F.min("r2")).alias("r2"), F.round(F.avg((F.col("va") - F.col("b") * F.col("vb")) / 1e6), 4).alias("mean"))
    return out


@add("p7_rate_contribution", f"""WITH {HEDGED}, w AS (SELECT *, first_value(rate) OVER (PARTITION BY pair ORDER BY t) AS rate0 FROM v)
SELECT pair, round(stddev_pop(va / 1e6), 4) AS sd_all, round(stddev_pop((va - va / rate * rate0) / 1e6), 4) AS sd_rate FROM w GROUP BY pair""")
def rate_contribution(m: Market) -> DataFrame:
    v = contract_values(m)
    first = v.groupBy("pair").agg(F.min_by("rate", "t").alias("rate0"))
    v = v.join(first, "pair")
    fixed = F.col("va") / F.col("rate") * F.col("rate0")
    return v.groupBy("pair").agg(F.round(F.stddev_pop(F.col("va") / 1e6), 4).alias("sd_all"), F.round(F.stddev_pop((F.col("va") - fixed) / 1e6), 4).alias("sd_rate"))


@add("p8_rebased", "SELECT instr, t, round(100 * close / first_value(close) OVER (PARTITION BY instr ORDER BY t), 6) AS level FROM bars")
def rebased(m: Market) -> DataFrame:
    first = F.first("close").over(Window.partitionBy("instr").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return m.bars.select("instr", "t", r6(100 * F.col("close") / first).alias("level"))


@add("a7_describe", "SELECT pair, count(s) AS n, round(avg(s), 9) AS mean, round(stddev_pop(s), 6) AS sd, round(arg_max(s, t), 6) AS last, round((arg_max(s, t) - avg(s)) / stddev_pop(s), 6) AS z FROM spread GROUP BY pair")
def describe(m: Market) -> DataFrame:
    out = stats.describe(m.spread, "pair", "s")
    return out.select("pair", "n", F.round("mean", 9).alias("mean"), *[r6(x).alias(x) for x in ("sd", "last", "z")])


@add("a8_sample_sd", "SELECT pair, round(stddev_samp(s), 6) AS sd FROM spread GROUP BY pair")
def sample_sd(m: Market) -> DataFrame:
    return m.spread.groupBy("pair").agg(r6(F.stddev_samp("s")).alias("sd"))


@add("a9_index_quartiles", "WITH l AS (SELECT pair, list_sort(list(s)) AS v FROM spread GROUP BY pair) SELECT pair, round(v[len(v) // 2 + 1], 6) AS med, round(v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1], 6) AS iqr FROM l")
def index_quartiles(m: Market) -> DataFrame:
    q = stats.index_quartiles(m.spread, "pair", "s")
    return q.select("pair", r6("med").alias("med"), r6(F.col("q3") - F.col("q1")).alias("iqr"))


@add("a10_quantiles", "SELECT pair, round(quantile_cont(s, 0.25), 6) AS q25, round(median(s), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75 FROM spread GROUP BY pair")
def quantiles(m: Market) -> DataFrame:
    return m.spread.groupBy("pair").agg(r6(F.percentile("s", 0.25)).alias("q25"), r6(F.median("s")).alias("q50"), r6(F.percentile("s", 0.75)).alias("q75"))


@add("a11_index_percentiles", """
WITH g AS (SELECT instr, date_diff('second', lag(t) OVER (PARTITION BY instr ORDER BY t), t) AS x FROM ticks), l AS (SELECT instr, list_sort(list(x)) AS v, median(x) AS p50 FROM g WHERE x IS NOT NULL GROUP BY instr)
SELECT instr, p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90, v[least(len(v) - 1, CAST(floor(len(v) * 0.99) AS BIGINT)) + 1] AS p99 FROM l""")
def index_percentiles(m: Market) -> DataFrame:
    w = Window.partitionBy("instr").orderBy("t")
    x = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("t").over(w)), F.date_trunc("second", F.col("t")))
    def place(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least(n - 1, F.floor(n * q))

    places = {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.floor(n / 2), "p90": place(0.9), "p99": place(0.99)}
    out = stats.ranked(m.ticks.select("instr", x.alias("x")), "instr", "x", places)
    return out.select("instr", ((F.col("lower") + F.col("upper")) / 2).alias("p50"), "p90", "p99")


OLS = """f AS (SELECT pair, count(*) AS n, regr_slope(d, x) AS b, regr_intercept(d, x) AS a, regr_r2(d, x) AS r2, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy, avg(x) AS mx FROM steps GROUP BY pair),
e AS (SELECT *, sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx) AS se FROM f)"""


@add("a12_ols", f"WITH {OLS} SELECT pair, n, round(a, 6) AS a, round(b, 6) AS b, round(r2, 6) AS r2, round(se, 6) AS se, round(b / se, 6) AS t FROM e")
def ols(m: Market) -> DataFrame:
    return stats.ols(m.steps, "pair", "x", "d").select("pair", "n", *[r6(x).alias(x) for x in ("a", "b", "r2", "se", "t")])


def hac_sql(lags: str) -> str:
    return f"""WITH {OLS}, u AS (SELECT s.pair, s.t, e.n, (x - mx) * (d - a - b * x) AS u FROM steps s JOIN e ON s.pair = e.pair),
i AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS k, {lags} AS m FROM u),
p AS (SELECT i.pair, sum(CASE WHEN j.k = i.k THEN 1 ELSE 2 * (1 - (i.k - j.k) / (i.m + 1.0)) END * i.u * j.u) AS s FROM i JOIN i j ON i.pair = j.pair AND j.k BETWEEN i.k - i.m AND i.k GROUP BY i.pair)
SELECT e.pair, e.n, round(b, 6) AS b, round(b / se, 5) AS t, round(b * sxx / sqrt(s), 5) AS t_hac FROM e JOIN p ON e.pair = p.pair"""


@add("a15_hac", hac_sql("10"))
def hac(m: Market) -> DataFrame:
    out = stats.hac(m.steps, "pair", "t", "x", "d")
    return out.select("pair", "n", r6("b").alias("b"), F.round("t", 5).alias("t"), F.round("t_hac", 5).alias("t_hac"))


@add("a16_hac_automatic", hac_sql("greatest(1, CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INTEGER))"))
def hac_automatic(m: Market) -> DataFrame:
    out = stats.hac(m.steps, "pair", "t", "x", "d", lags=None)
    return out.select("pair", "n", r6("b").alias("b"), F.round("t", 5).alias("t"), F.round("t_hac", 5).alias("t_hac"))


@add("a17_reversion", """
WITH l AS (SELECT pair, sid, t, 20 * sid + s / 100 AS s FROM spread), q AS (SELECT pair, t, s, lag(s) OVER (PARTITION BY pair ORDER BY t) AS x FROM l),
f AS (SELECT pair, count(x) AS n, regr_slope(s, x) AS b, regr_intercept(s, x) AS a, regr_syy(s, x) AS syy, regr_sxy(s, x) AS sxy FROM q GROUP BY pair)
SELECT pair, n, round(b, 6) AS b, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) END, 6) AS kappa, round(CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) END, 4) AS half_life,
 round(CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) END, 4) AS mu, round(CASE WHEN b > 0 AND b < 1 THEN sqrt(greatest(syy - b * sxy, 0) / (n - 2)) / sqrt(1 - b * b) END, 5) AS sigma_eq FROM f""")
def reversion(m: Market) -> DataFrame:
    # a level that drifts with the session, so that some pairs have 0 < b < 1
    level = m.spread.select("pair", "t", (20 * F.col("sid") + F.col("s") / 100).alias("s"))
    rows = level.withColumn("x", F.lag("s").over(Window.partitionBy("pair").orderBy("t")))
    out = stats.reversion(stats.ols(rows, "pair", "x", "s"))
    return out.select("pair", "n", r6("b").alias("b"), r6("kappa").alias("kappa"), F.round("half_life", 4).alias("half_life"), F.round("mu", 4).alias("mu"), F.round("sigma_eq", 5).alias("sigma_eq"))


@add("a19_effective_spread", """
WITH d AS (SELECT pair, t, s - lag(s) OVER (PARTITION BY pair, sid ORDER BY t) AS d FROM spread), e AS (SELECT *, avg(d) OVER (PARTITION BY pair) AS m FROM d WHERE d IS NOT NULL),
p AS (SELECT pair, (d - m) * (lag(d) OVER (PARTITION BY pair ORDER BY t) - m) AS p FROM e)
SELECT pair, count(*) AS n, round(sum(p) / (count(*) - 1), 4) AS cov, round(CASE WHEN count(*) >= 30 AND sum(p) < 0 THEN 2 * sqrt(-sum(p) / (count(*) - 1)) END, 5) AS roll FROM p GROUP BY pair""")
def effective_spread(m: Market) -> DataFrame:
    return stats.effective_spread(m.spread, "pair", "t", "s").select("pair", "n", F.round("cov", 4).alias("cov"), F.round("roll", 5).alias("roll"))


@add("a20_illiquidity", "WITH r AS (SELECT instr, abs(close / lag(close) OVER (PARTITION BY instr ORDER BY t) - 1) / nullif(volume, 0) AS x FROM bars) SELECT instr, round(avg(x) * 1e6, 4) AS amihud FROM r GROUP BY instr")
def illiquidity(m: Market) -> DataFrame:
    return stats.illiquidity(m.bars, "instr", "t").select("instr", F.round("amihud", 4).alias("amihud"))


@add("a21_signed_flow", """
WITH f AS (SELECT instr, t, volume, sign(close - lag(close) OVER (PARTITION BY instr ORDER BY t)) * volume AS f FROM bars), g AS (SELECT *, lag(f) OVER (PARTITION BY instr ORDER BY t) AS g FROM f)
SELECT instr, round(sum(f) / sum(volume), 6) AS ratio, round(corr(f, g), 6) AS persistence FROM g GROUP BY instr""")
def signed_flow(m: Market) -> DataFrame:
    return stats.signed_flow(m.bars, "instr", "t").select("instr", r6("ratio").alias("ratio"), r6("persistence").alias("persistence"))


@add("a22_correlation", "SELECT pair, round(CASE WHEN count(*) >= 10 THEN corr(a_close, b_close) END, 6) AS r FROM aligned GROUP BY pair")
def correlation(m: Market) -> DataFrame:
    return m.aligned.groupBy("pair").agg(r6(F.when(F.count("*") >= 10, c.correlation(F.col("a_close"), F.col("b_close")))).alias("r"))


@add("a23_durations", """
WITH z AS (SELECT pair, t, (s - avg(s) OVER (PARTITION BY pair)) / stddev_pop(s) OVER (PARTITION BY pair) AS z FROM spread),
g AS (SELECT pair, CAST(date_diff('minute', lag(t) OVER (PARTITION BY pair ORDER BY t), t) AS DOUBLE) AS g FROM z WHERE abs(z) >= 1)
SELECT pair, count(*) AS n, round(avg(g), 9) AS mean, median(g) AS median, round(stddev_pop(g) / avg(g), 6) AS cv FROM g WHERE g > 1 GROUP BY pair""")
def durations(m: Market) -> DataFrame:
    w = Window.partitionBy("pair")
    z = m.spread.withColumn("z", c.zscore(F.col("s"), F.avg("s").over(w), F.stddev_pop("s").over(w))).where(F.abs("z") >= 1)
    return stats.durations(z, "pair", "t").select("pair", "n", F.round("mean", 9).alias("mean"), "median", r6("cv").alias("cv"))


@add("a32_standardised", "SELECT pair, t, round((s - avg(s) OVER p) / stddev_pop(s) OVER p, 6) AS z FROM spread WINDOW p AS (PARTITION BY pair)")
def standardised(m: Market) -> DataFrame:
    w = Window.partitionBy("pair")
    return m.spread.select("pair", "t", r6(c.zscore(F.col("s"), F.avg("s").over(w), F.stddev_pop("s").over(w))).alias("z"))


def rolling_sql(part: str, bounds: str, least: int, sd: str = "stddev_pop") -> str:
    return f"""SELECT pair, t, round(CASE WHEN count(s) OVER w >= {least} THEN avg(s) OVER w END, 9) AS mean, round(CASE WHEN count(s) OVER w >= {least} AND {sd}(s) OVER w > 1e-9 THEN (s - avg(s) OVER w) / {sd}(s) OVER w END, 5) AS z
 FROM spread WINDOW w AS (PARTITION BY {part} ORDER BY t ROWS BETWEEN {bounds})"""


def rolled(df: DataFrame) -> DataFrame:
    return df.select("pair", "t", F.round("r_mean", 9).alias("mean"), F.round("r_z", 5).alias("z"))


@add("w3_rolling_stats", rolling_sql("pair, sid", "119 PRECEDING AND CURRENT ROW", 30))
def rolling_stats(m: Market) -> DataFrame:
    return rolled(stats.rolling(m.spread, ["pair", "sid"], "t", "s", 120, 30))


@add("w5_rolling_z_exclusive", rolling_sql("pair", "60 PRECEDING AND 1 PRECEDING", 60))
def rolling_exclusive(m: Market) -> DataFrame:
    return rolled(stats.rolling(m.spread, ["pair"], "t", "s", 60, 60, inclusive=False))


@add("w6_rolling_z_full_sample", rolling_sql("pair", "119 PRECEDING AND CURRENT ROW", 120, "stddev_samp"))
def rolling_full(m: Market) -> DataFrame:
    return rolled(stats.rolling(m.spread, ["pair"], "t", "s", 120, 120, sample=True))


@add("w7_rolling_beta", "SELECT pair, t, round(CASE WHEN count(*) OVER w >= 30 THEN regr_slope(ln(a_close), ln(b_close)) OVER w END, 5) AS beta FROM pair_bars WINDOW w AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)")
def rolling_beta(m: Market) -> DataFrame:
    logs = m.pair_bars.select("pair", "sid", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    return stats.rolling_beta(logs, ["pair", "sid"], "t", "lb", "la", 240, 30).select("pair", "t", F.round("beta", 5).alias("beta"))


@add("w8_lagged_beta", "SELECT pair, t, round(CASE WHEN count(*) OVER w = 60 THEN coalesce(regr_slope(ln(a_close), ln(b_close)) OVER w, 1) END, 5) AS beta FROM pair_bars WINDOW w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def lagged_beta(m: Market) -> DataFrame:
    logs = m.pair_bars.select("pair", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    return stats.rolling_beta(logs, ["pair"], "t", "lb", "la", 60, 60, inclusive=False, fallback=1.0).select("pair", "t", F.round("beta", 5).alias("beta"))


@add("w9_rolling_quartiles", """
WITH l AS (SELECT pair, t, list_sort(list(s) OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS v FROM spread)
SELECT pair, t, round(CASE WHEN len(v) = 60 THEN v[31] END, 6) AS med, round(CASE WHEN len(v) = 60 THEN v[46] - v[16] END, 6) AS iqr FROM l""")
def rolling_quartiles(m: Market) -> DataFrame:
    return stats.rolling_quartiles(m.spread, ["pair"], "t", "s", 60).select("pair", "t", r6("r_med").alias("med"), r6("r_iqr").alias("iqr"))


@add("w9_long_quartiles", """
WITH l AS (SELECT instr, t, list_sort(list(px) OVER (PARTITION BY instr ORDER BY t ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) AS v FROM ticks)
SELECT instr, t, round(CASE WHEN len(v) = 1000 THEN v[501] END, 6) AS med, round(CASE WHEN len(v) = 1000 THEN v[751] - v[251] END, 6) AS iqr FROM l""")
def long_quartiles(m: Market) -> DataFrame:
    """Quartiles of the thousand prices before each tick, from values kept in order."""
    out = scans.rolling_quartiles(m.ticks.select("instr", "t", "px"), ["instr"], "t", "px", 1000)
    return out.select("instr", "t", r6("r_med").alias("med"), r6("r_iqr").alias("iqr"))


@add("w11_average_cross", """
SELECT pair, t, CASE WHEN count(*) OVER l < 60 THEN 0 ELSE CAST(sign(round(avg(s) OVER k - avg(s) OVER l, 9)) AS INTEGER) END AS pos FROM spread
WINDOW l AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), k AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def average_cross(m: Market) -> DataFrame:
    long, short = stats.frame(["pair", "sid"], "t", 60), stats.frame(["pair", "sid"], "t", 20)
    side = F.signum(F.round(F.avg("s").over(short) - F.avg("s").over(long), 9)).cast("int")
    return m.spread.select("pair", "t", F.when(F.count("*").over(long) < 60, 0).otherwise(side).alias("pos"))


@add("w12_drawdown", """
WITH c AS (SELECT pair, t, sum(d) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM steps)
SELECT pair, t, round(total, 5) AS total, round(total - max(total) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS drawdown FROM c""")
def drawdown(m: Market) -> DataFrame:
    return scans.drawdown(m.steps, ["pair"], "t", "d").select("pair", "t", F.round("total", 5).alias("total"), F.round("drawdown", 5).alias("drawdown"))


@add("w15_lead_lag", """
WITH r AS (SELECT pair, t, ln(a_close) - lag(ln(a_close)) OVER w AS ra, ln(b_close) - lag(ln(b_close)) OVER w AS rb FROM aligned WINDOW w AS (PARTITION BY pair ORDER BY t)),
i AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS k, count(*) OVER (PARTITION BY pair) AS n FROM r WHERE ra IS NOT NULL),
l AS (SELECT x.pair, y.k - x.k AS lag, coalesce(corr(x.ra, y.rb), 0) AS c FROM i x JOIN i y ON x.pair = y.pair AND y.k - x.k BETWEEN -10 AND 10 WHERE x.n >= 30 GROUP BY ALL)
SELECT pair, CAST(arg_min(lag, o) AS INTEGER) AS lag, round(arg_min(c, o), 6) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(abs(c), 9) DESC, CASE WHEN lag > 0 THEN 2 * lag - 1 ELSE -2 * lag END) AS o FROM l) GROUP BY pair""")
def lead_lag(m: Market) -> DataFrame:
    w = Window.partitionBy("pair").orderBy("t")
    r = m.aligned.select("pair", "t", (F.ln("a_close") - F.lag(F.ln("a_close")).over(w)).alias("ra"), (F.ln("b_close") - F.lag(F.ln("b_close")).over(w)).alias("rb")).where("ra is not null")
    return stats.lead_lag(r, "pair", "t", "ra", "rb", 10).select("pair", "lag", r6("corr").alias("corr"))


@add("w16_inter_arrival", """
WITH g AS (SELECT instr, date_diff('second', lag(t) OVER (PARTITION BY instr ORDER BY t), t) AS g FROM ticks) SELECT instr, count(*) AS n, round(avg(g), 9) AS mean, max(g) AS longest FROM g WHERE g > 0 AND g <= 300 GROUP BY instr""")
def inter_arrival(m: Market) -> DataFrame:
    w = Window.partitionBy("instr").orderBy("t")
    g = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("t").over(w)), F.date_trunc("second", F.col("t")))
    return m.ticks.select("instr", g.alias("g")).where("g > 0 and g <= 300").groupBy("instr").agg(F.count("*").alias("n"), F.round(F.avg("g"), 9).alias("mean"), F.max("g").alias("longest"))


@add("a26_beta_dispersion", """
WITH b AS (SELECT pair, t, CASE WHEN count(*) OVER w >= 30 THEN regr_slope(ln(a_close), ln(b_close)) OVER w END AS beta FROM pair_bars WINDOW w AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM b WHERE beta IS NOT NULL)
SELECT pair, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN stddev_pop(beta) END, 5) AS sd, round(stddev_pop(beta) FILTER (k <= 60), 5) AS sd_last FROM k GROUP BY pair""")
def beta_dispersion(m: Market) -> DataFrame:
    logs = m.pair_bars.select("pair", "sid", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    b = stats.rolling_beta(logs, ["pair", "sid"], "t", "lb", "la", 60, 30).where("beta is not null")
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("t"))))
    return b.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 10, F.stddev_pop("beta")), 5).alias("sd"), F.round(F.stddev_pop(F.when(F.col("k") <= 60, F.col("beta"))), 5).alias("sd_last"))


PAIR_REPORT = f"""WITH {OLS}, u AS (SELECT s.pair, s.t, (x - mx) * (d - a - b * x) AS u FROM steps s JOIN e ON s.pair = e.pair),
i AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS k FROM u),
p AS (SELECT i.pair, sum(CASE WHEN j.k = i.k THEN 1 ELSE 2 * (1 - (i.k - j.k) / 11.0) END * i.u * j.u) AS s FROM i JOIN i j ON i.pair = j.pair AND j.k BETWEEN i.k - 10 AND i.k GROUP BY i.pair),
g AS (SELECT pair, count(*) AS n_bars, count(DISTINCT sid) AS n_sessions, arg_max(s, t) AS last, avg(s) AS mean, stddev_pop(s) AS sd FROM spread GROUP BY pair)
SELECT g.pair, n_bars, coalesce(e.n, 0) AS n_steps, n_sessions, round(last, 6) AS spread_now, round((last - mean) / sd, 6) AS z, round(1 + b, 6) AS ar1, round(CASE WHEN b > -1 AND b < 0 THEN ln(2) / -ln(1 + b) END, 5) AS half_life, round(b, 6) AS gamma, round(b * sxx / sqrt(p.s), 5) AS t_hac
FROM g LEFT JOIN e ON g.pair = e.pair LEFT JOIN p ON g.pair = p.pair"""


def pair_report(m: Market) -> DataFrame:
    """One row per pair: aligned bars, sessions, consecutive steps, spread, z, AR(1), half-life, ECM gamma and HAC t; the
    estimates are null for a pair without steps."""
    spread = m.spread
    size = spread.groupBy("pair").agg(F.count("*").alias("n_bars"), F.count_distinct("sid").alias("n_sessions"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.max_by("s", "t").alias("last"))
    fit = stats.hac(m.steps, "pair", "t", "x", "d").withColumnRenamed("n", "n_steps")
    ar1 = 1 + F.col("b")
    half = F.when((ar1 > 0) & (ar1 < 1), F.ln(F.lit(2.0)) / -F.ln(ar1))
    return size.join(fit, "pair", "left").select(
        "pair", "n_bars", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "n_sessions", r6("last").alias("spread_now"), r6(c.zscore(F.col("last"), F.col("mean"), F.col("sd"))).alias("z"),
        r6(ar1).alias("ar1"), F.round(half, 5).alias("half_life"), r6("b").alias("gamma"), F.round("t_hac", 5).alias("t_hac"))


add("g14_pair_report", PAIR_REPORT)(pair_report)
