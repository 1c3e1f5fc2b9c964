"""Queries over books, gates, positions, simulations and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import r6
from spreadloom.operators import book, models, scans, sessions, signals, stats
from spreadloom.plans.market import Catalog, Market
from spreadloom.plans.series import OLS, pair_report

catalog = Catalog()
add = catalog.add

LEVEL = """lv AS (SELECT *, bids[1].px AS bp, asks[1].px AS ap, bids[1].qty AS bq, asks[1].qty AS aq, (bids[1].px + asks[1].px) / 2 AS mid FROM quotes)"""


def rounded(df: DataFrame, names: tuple[str, ...], digits: int = 5) -> DataFrame:
    return df.select("instr", "t", *[F.round(n, digits).alias(n) for n in names])


@add("f19_book_features", f"""WITH {LEVEL} SELECT instr, t, round(mid, 5) AS mid, round((ap - bp) / mid * 1e4, 5) AS spread_bps, round(CASE WHEN bq + aq = 0 THEN 0 ELSE (bq - aq) / (bq + aq) END, 5) AS obi,
 round(CASE WHEN bq + aq = 0 THEN 0 ELSE (bq * ap + aq * bp) / (bq + aq) - mid END, 5) AS tilt FROM lv""")
def book_features(m: Market) -> DataFrame:
    return rounded(book.features(m.quotes, ["instr"], flows=False), ("mid", "spread_bps", "obi", "tilt"))


@add("f20_level_imbalance", """WITH w AS (SELECT instr, t, list_sum([bids[i].qty / i FOR i IN [1, 2, 3, 4, 5]]) AS b, list_sum([asks[i].qty / i FOR i IN [1, 2, 3, 4, 5]]) AS a FROM quotes)
SELECT instr, t, round(CASE WHEN a + b = 0 THEN 0 ELSE (b - a) / (b + a) END, 8) AS obi_levels FROM w""")
def level_imbalance(m: Market) -> DataFrame:
    return rounded(book.features(m.quotes, ["instr"], flows=False), ("obi_levels",), 8)


@add("f21_depth", f"""WITH {LEVEL} SELECT instr, t, round(coalesce(list_sum([x.qty FOR x IN bids IF x.px >= mid * 0.99]), 0) + coalesce(list_sum([x.qty FOR x IN asks IF x.px <= mid * 1.01]), 0), 5) AS depth FROM lv""")
def depth(m: Market) -> DataFrame:
    return rounded(book.features(m.quotes, ["instr"], flows=False), ("depth",))


def walk_sql(side: str) -> str:
    return f"(SELECT CASE WHEN sum(q) >= 10 THEN sum(greatest(least(q, 10 - before), 0) * px) / 10 END FROM (SELECT x.px AS px, x.qty AS q, coalesce(sum(x.qty) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT unnest({side}) AS x, generate_subscripts({side}, 1) AS i)))"


@add("f22_liquidity_cost", f"""WITH {LEVEL}, w AS (SELECT instr, t, mid, {walk_sql('asks')} AS buy, {walk_sql('bids')} AS sell FROM lv) SELECT instr, t, round(((buy - mid) + (mid - sell)) / 2 / mid * 1e4, 4) AS cost FROM w""")
def liquidity(m: Market) -> DataFrame:
    return rounded(book.features(m.quotes, ["instr"], flows=False), ("cost",), 4)


def flow_sql(i: int) -> str:
    b, a, ob, oa = f"bids[{i}]", f"asks[{i}]", f"ob[{i}]", f"oa[{i}]"
    return (f"(CASE WHEN {b}.px > {ob}.px THEN {b}.qty WHEN {b}.px < {ob}.px THEN 0 ELSE {b}.qty - {ob}.qty END"
            f" - CASE WHEN {a}.px > {oa}.px THEN 0 WHEN {a}.px < {oa}.px THEN {a}.qty ELSE {a}.qty - {oa}.qty END)")  # fmt: skip


@add("w18_order_flow", f"""WITH p AS (SELECT *, lag(bids) OVER (PARTITION BY instr ORDER BY t) AS ob, lag(asks) OVER (PARTITION BY instr ORDER BY t) AS oa FROM quotes)
SELECT instr, t, round(CASE WHEN ob IS NOT NULL THEN {flow_sql(1)} END, 5) AS voi, round(CASE WHEN ob IS NOT NULL THEN {' + '.join(flow_sql(i) for i in range(1, 6))} END, 5) AS mlofi FROM p""")
def order_flow(m: Market) -> DataFrame:
    return rounded(book.features(m.quotes, ["instr"]), ("voi", "mlofi"))


@add("w17_refill_times", """
WITH RECURSIVE s AS (SELECT instr, t, 'bid' AS side, coalesce(bids[1].qty, 0) AS qty FROM quotes UNION ALL SELECT instr, t, 'ask', coalesce(asks[1].qty, 0) FROM quotes),
o AS (SELECT *, row_number() OVER w AS k, lag(qty) OVER w AS base FROM s WINDOW w AS (PARTITION BY instr, side ORDER BY t)),
d AS (SELECT * FROM o WHERE base > 0 AND qty <= base * 0.5),
e AS (SELECT d.instr, d.side, d.k, any_value(d.t) AS t, min(o.k) AS j, arg_min(o.t, o.k) AS back, arg_min(o.qty, o.k) >= any_value(d.base) AS full_again
 FROM d LEFT JOIN o ON o.instr = d.instr AND o.side = d.side AND o.k > d.k AND (o.qty >= d.base OR o.t > d.t + INTERVAL '300 seconds') GROUP BY d.instr, d.side, d.k),
w AS (SELECT e.* FROM e JOIN (SELECT instr, side, min(k) AS k FROM e GROUP BY ALL) f ON e.instr = f.instr AND e.side = f.side AND e.k = f.k
 UNION ALL SELECT n.* FROM (SELECT w.instr, w.side, (SELECT min(x.k) FROM e x WHERE x.instr = w.instr AND x.side = w.side AND x.k > w.j) AS k FROM w) p JOIN e n ON n.instr = p.instr AND n.side = p.side AND n.k = p.k)
SELECT instr, side, t, date_diff('microsecond', t, back) / 1e6 AS seconds FROM w WHERE full_again AND back > t AND back <= t + INTERVAL '300 seconds'""")
def refill_times(m: Market) -> DataFrame:
    return book.refills(m.quotes, "instr")


def scored(m: Market, rows: int = 24, least: int = 12) -> DataFrame:
    """Spread bars with a rolling in-session score, rounded so that both engines see the same crossings."""
    z = stats.rolling(m.spread, ["pair", "sid"], "t", "s", rows, least)
    return z.withColumn("z", F.round("r_z", 6))


SCORED = """sc AS (SELECT *, round(CASE WHEN count(s) OVER w >= 12 AND stddev_pop(s) OVER w > 1e-9 THEN (s - avg(s) OVER w) / stddev_pop(s) OVER w END, 6) AS z, row_number() OVER (PARTITION BY pair, sid ORDER BY t) AS k
 FROM spread WINDOW w AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def path_sql(leave: str, extra: str = "", enter: str = "2") -> str:
    return f"""WITH RECURSIVE {SCORED}, w AS (SELECT pair, sid, t, k, z, CASE WHEN abs(z) >= {enter} THEN -CAST(sign(z) AS INTEGER) ELSE 0 END AS pos FROM sc WHERE k = 1
UNION ALL SELECT x.pair, x.sid, x.t, x.k, x.z, CASE WHEN x.z IS NULL THEN w.pos WHEN w.pos = 0 AND abs(x.z) >= {enter} THEN -CAST(sign(x.z) AS INTEGER) WHEN w.pos <> 0 AND {leave} THEN 0 ELSE w.pos END FROM w JOIN sc x ON x.pair = w.pair AND x.sid = w.sid AND x.k = w.k + 1)
SELECT pair, sid, t, {extra or 'pos'} AS pos FROM w"""


@add("g1_reversion_positions", path_sql("abs(x.z) <= 0.25"))
def reversion_positions(m: Market) -> DataFrame:
    return scans.held(scored(m), ["pair", "sid"], "t", "z", 2.0, 0.25)


@add("g2_band_positions", path_sql("x.z * w.pos >= 0"))
def band_positions(m: Market) -> DataFrame:
    return signals.held(scored(m), ["pair", "sid"], "t", "z", 2.0, 0.0, cross=True)


@add("g3_equilibrium_positions", path_sql("abs(x.z) <= 0.3", enter="1"))
def equilibrium_positions(m: Market) -> DataFrame:
    """Bands of one equilibrium deviation around the rolling mean, left at 0.3 of it."""
    return signals.held(scored(m), ["pair", "sid"], "t", "z", 1.0, 0.3)


@add("g5_hold_positions", "SELECT pair, sid, t, 1 AS pos FROM spread")
def hold_positions(m: Market) -> DataFrame:
    return m.spread.select("pair", "sid", "t", F.lit(1).alias("pos"))


BACKTEST = """b AS (SELECT pair, t, ln(a_close) AS la, ln(b_close) AS lb, CASE WHEN count(*) OVER w = 60 THEN coalesce(regr_slope(ln(a_close), ln(b_close)) OVER w, 1) END AS beta FROM aligned WINDOW w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
s AS (SELECT pair, t, la - beta * lb AS s FROM b WHERE beta IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS k, round(CASE WHEN count(s) OVER w = 60 AND stddev_pop(s) OVER w > 1e-9 THEN (s - avg(s) OVER w) / stddev_pop(s) OVER w END, 6) AS z FROM s WINDOW w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


@add("g7_spread_backtest", f"""WITH RECURSIVE {BACKTEST},
w AS (SELECT pair, t, k, s, z, CASE WHEN abs(z) >= 1.5 THEN -CAST(sign(z) AS INTEGER) ELSE 0 END AS pos, z AS entry, 0.0::DOUBLE AS pnl FROM z WHERE k = 1
UNION ALL SELECT x.pair, x.t, x.k, x.s, x.z, CASE WHEN w.pos = 0 THEN CASE WHEN abs(x.z) >= 1.5 THEN -CAST(sign(x.z) AS INTEGER) ELSE 0 END WHEN abs(x.z) <= 0.5 OR -w.pos * (x.z - w.entry) >= 1 THEN 0 ELSE w.pos END,
 CASE WHEN w.pos = 0 THEN x.z ELSE w.entry END, w.pnl + w.pos * (x.s - w.s) FROM w JOIN z x ON x.pair = w.pair AND x.k = w.k + 1)
SELECT pair, t, z, round(pnl, 4) AS pnl FROM w""")
def spread_backtest(m: Market) -> DataFrame:
    logs = m.aligned.select("pair", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    out = signals.spread_backtest(logs, "pair", "t", "la", "lb", 60, 1.5)
    return out.select("pair", "t", "z", F.round("pnl", 4).alias("pnl"))


HEDGE_PATHS = """WITH RECURSIVE dm AS (SELECT pair, a_close - lag(a_close) OVER w AS da, b_close - lag(b_close) OVER w AS db FROM pair_bars WINDOW w AS (PARTITION BY pair, sid ORDER BY t)),
fb AS (SELECT pair, regr_slope(da, db) AS beta FROM dm WHERE da IS NOT NULL GROUP BY pair),
hb AS (SELECT p.pair, sid, t, a_open - beta * b_open AS open, a_close - beta * b_close AS close FROM pair_bars p JOIN fb ON fb.pair = p.pair),
rk AS (SELECT pair, sqrt(avg(d * d)) / sqrt(3600) * sqrt(10) * sqrt(2 / pi()) AS risk FROM (SELECT pair, close - lag(close) OVER (PARTITION BY pair, sid ORDER BY t) AS d FROM hb) GROUP BY pair),
sc AS (SELECT *, round(CASE WHEN count(close) OVER w >= 20 AND stddev_pop(close) OVER w > 1e-9 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END, 6) AS z, row_number() OVER (PARTITION BY pair, sid ORDER BY t) AS k
 FROM hb WINDOW w AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
st AS (SELECT * FROM (VALUES ('reversion 2', 2.0, 0.25, false), ('reversion 1.5', 1.5, 0.25, false), ('band', 2.0, 0.0, true), ('equilibrium', 1.0, 0.3, false)) v(strategy, enter, leaves, crosses)),
w AS (SELECT strategy, enter, leaves, crosses, pair, sid, t, k, CASE WHEN abs(z) >= enter THEN -CAST(sign(z) AS INTEGER) ELSE 0 END AS pos FROM sc, st WHERE k = 1
UNION ALL SELECT w.strategy, w.enter, w.leaves, w.crosses, x.pair, x.sid, x.t, x.k, CASE WHEN x.z IS NULL THEN w.pos WHEN w.pos = 0 AND abs(x.z) >= w.enter THEN -CAST(sign(x.z) AS INTEGER)
 WHEN w.pos <> 0 AND CASE WHEN w.crosses THEN x.z * w.pos >= 0 ELSE abs(x.z) <= w.leaves END THEN 0 ELSE w.pos END FROM w JOIN sc x ON x.pair = w.pair AND x.sid = w.sid AND x.k = w.k + 1),
po AS (SELECT strategy, pair, sid, t, pos FROM w UNION ALL SELECT 'momentum', pair, sid, t, -pos FROM w WHERE strategy = 'reversion 2' UNION ALL SELECT 'hold', pair, sid, t, 1 FROM hb),
l AS (SELECT po.*, b.open, coalesce(lag(pos) OVER o, 0) AS old, lead(b.open) OVER o AS px, row_number() OVER o AS r, count(*) OVER (PARTITION BY strategy, po.pair, po.sid) AS n
 FROM po JOIN hb b ON b.pair = po.pair AND b.sid = po.sid AND b.t = po.t WINDOW o AS (PARTITION BY strategy, po.pair, po.sid ORDER BY po.t)),
tr AS (SELECT strategy, pair, pos - old AS delta, px FROM l WHERE r < n AND pos <> old UNION ALL SELECT strategy, pair, -old, open FROM l WHERE r = n AND old <> 0),
wy AS (SELECT pair, 'two legs' AS way, 0.04::DOUBLE AS half, risk AS leg FROM rk UNION ALL SELECT pair, 'listed', 0.02, 0.0 FROM rk),
g AS (SELECT tr.pair, way, half, leg, strategy, count(*) AS fills, -sum(px * delta) AS gross, -sum(px * delta) - sum(abs(delta) * (half + 0.0025 + leg)) AS net FROM tr JOIN wy ON wy.pair = tr.pair GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY pair, way ORDER BY net DESC, strategy) AS place FROM g)
SELECT pair, way, place, strategy, fills, round(gross, 6) AS gross, round(net, 6) AS net, round(2 * half + 0.005 + 2 * leg, 6) AS round_trip FROM x WHERE place <= 3"""


@add("g18_hedge_paths", HEDGE_PATHS)
def hedge_paths(m: Market, rows: int = 40, tick: float = 0.02, fee: float = 0.005, lag: float = 10.0) -> DataFrame:
    """Six strategies on the spread under the pair's own hedge ratio, by two ways to trade it: both legs (two ticks and leg
    risk) or a listed spread (one tick). The three best of each way, with a round trip's cost."""
    w = Window.partitionBy("pair", "sid").orderBy("t")
    moves = m.pair_bars.select("pair", (F.col("a_close") - F.lag("a_close").over(w)).alias("da"), (F.col("b_close") - F.lag("b_close").over(w)).alias("db")).where("da is not null")
    fit = stats.ols(moves, "pair", "db", "da").select("pair", F.col("b").alias("beta"))
    bars = m.pair_bars.join(fit, "pair").select(
        "pair", "sid", "t", (F.col("a_open") - F.col("beta") * F.col("b_open")).alias("open"), (F.col("a_close") - F.col("beta") * F.col("b_close")).alias("close"))
    step = F.col("close") - F.lag("close").over(w)
    risk = bars.select("pair", step.alias("d")).groupBy("pair").agg(
        (F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.sqrt(F.lit(m.scale.bar * 60.0)) * F.sqrt(F.lit(lag)) * F.sqrt(2 / F.pi())).alias("risk"))
    keys = ["pair", "sid"]
    z = stats.rolling(bars, keys, "t", "close", rows, rows // 2).withColumn("z", F.round("r_z", 6))
    named = {"reversion 2": signals.held(z, keys, "t", "z", 2.0, 0.25), "reversion 1.5": signals.held(z, keys, "t", "z", 1.5, 0.25), "band": signals.held(z, keys, "t", "z", 2.0, 0.0, cross=True),
             "equilibrium": signals.held(z, keys, "t", "z", 1.0, 0.3), "hold": bars.select(*keys, "t", F.lit(1).alias("pos"))}
    named["momentum"] = named["reversion 2"].withColumn("pos", -F.col("pos"))
    pos = reduce(DataFrame.unionByName, [p.withColumn("strategy", F.lit(n)) for n, p in named.items()])
    ways = F.explode(F.array(F.struct(F.lit("two legs").alias("way"), F.lit(2 * tick).alias("half"), F.col("risk").alias("leg")), F.struct(F.lit("listed").alias("way"), F.lit(tick).alias("half"), F.lit(0.0).alias("leg"))))
    each = bars.join(pos, [*keys, "t"]).join(risk, "pair").select("*", ways.alias("p")).select("strategy", "p.way", "p.half", "p.leg", "pair", "sid", "t", "open", "close", "pos")
    trades = signals.fills(each, ["strategy", "way", "half", "leg", "pair", "sid"], "t", F.col("half"), fee, F.col("leg"))
    out = signals.results(trades, ["pair", "way", "half", "leg", "strategy"])
    place = F.row_number().over(Window.partitionBy("pair", "way").orderBy(F.desc("net"), "strategy")).cast("long")
    out = out.withColumn("place", place).where("place <= 3")
    return out.select("pair", "way", "place", "strategy", "fills", r6("gross").alias("gross"), r6("net").alias("net"), r6(2 * F.col("half") + fee + 2 * F.col("leg")).alias("round_trip"))


@add("g4_momentum_positions", path_sql("abs(x.z) <= 0.25", "-pos"))
def momentum_positions(m: Market) -> DataFrame:
    return reversion_positions(m).withColumn("pos", -F.col("pos"))


FILLS = """po AS (SELECT pair, sid, t, a_open - b_open AS open, s AS close, k, CASE WHEN z >= 1 THEN -1 WHEN z <= -1 THEN 1 ELSE 0 END AS pos FROM sc),
l AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS old, lead(open) OVER w AS px, lead(t) OVER w AS nt, count(*) OVER (PARTITION BY pair, sid) AS n FROM po WINDOW w AS (PARTITION BY pair, sid ORDER BY t)),
tr AS (SELECT pair, sid, nt AS t, pos - old AS delta, px, close AS decision FROM l WHERE k < n AND pos <> old UNION ALL SELECT pair, sid, t, -old, open, NULL FROM l WHERE k = n AND old <> 0)"""


def trades(m: Market) -> DataFrame:
    z = scored(m).select("pair", "sid", "t", (F.col("a_open") - F.col("b_open")).alias("open"), F.col("s").alias("close"), F.when(F.col("z") >= 1, -1).when(F.col("z") <= -1, 1).otherwise(0).alias("pos"))
    return signals.fills(z, ["pair", "sid"], "t", F.lit(0.01), 0.004, F.lit(0.002))


@add("g6_fills", f"WITH {SCORED}, {FILLS} SELECT pair, sid, t, delta, round(px, 6) AS px, round(abs(delta) * (0.01 + 0.004 / 2), 6) AS cost, round(coalesce((px - decision) * delta, 0), 6) AS shortfall FROM tr")
def fills(m: Market) -> DataFrame:
    return trades(m).select("pair", "sid", "t", "delta", r6("px").alias("px"), r6("cost").alias("cost"), r6("shortfall").alias("shortfall"))


@add("g6_results", f"""WITH {SCORED}, {FILLS} SELECT pair, count(*) AS fills, round(-sum(px * delta), 4) AS gross, round(sum(abs(delta)) * 0.012::DOUBLE, 4) AS cost, round(sum(abs(delta)) * 0.002::DOUBLE, 4) AS leg_cost, round(sum(coalesce((px - decision) * delta, 0)), 4) AS shortfall,
 round(-sum(px * delta) - sum(abs(delta)) * 0.014::DOUBLE, 4) AS net FROM tr GROUP BY pair""")
def run_results(m: Market) -> DataFrame:
    out = signals.results(trades(m), ["pair"])
    return out.select("pair", "fills", *[F.round(x, 4).alias(x) for x in ("gross", "cost", "leg_cost", "shortfall", "net")])


@add("g8_parameter_sweep")
def parameter_sweep(m: Market) -> DataFrame:
    logs = m.aligned.select("pair", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    return signals.sweep(logs, "pair", "t", "la", "lb").withColumn("total", r6("total"))


@add("a24_pnl_metrics", """WITH c AS (SELECT pair, t, d, sum(d) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM steps), p AS (SELECT *, v - max(v) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS dd FROM c)
SELECT pair, round(sum(d), 4) AS total, round(avg(d) / stddev_pop(d) * sqrt(252), 6) AS ratio, round(avg(d) / sqrt(avg(d * d)) * sqrt(252 * 400), 6) AS rms_ratio, round(min(dd), 4) AS drawdown, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS hits FROM p GROUP BY pair""")
def pnl_metrics(m: Market) -> DataFrame:
    d = stats.drawdown(m.steps, ["pair"], "t", "d")
    return d.groupBy("pair").agg(
        F.round(F.sum("d"), 4).alias("total"), r6(F.avg("d") / F.stddev_pop("d") * F.sqrt(F.lit(252.0))).alias("ratio"), r6(F.avg("d") / F.sqrt(F.avg(F.col("d") * F.col("d"))) * F.sqrt(F.lit(252.0 * 400))).alias("rms_ratio"),
        F.round(F.min("drawdown"), 4).alias("drawdown"), r6(F.avg((F.col("d") > 0).cast("double"))).alias("hits"))


@add("g10_quartile_gates", """WITH g AS (SELECT pair, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3, median(s) AS med, arg_max(s, t) AS last, list_sort(list(s)) AS v FROM spread GROUP BY pair)
SELECT pair, abs(last - v[len(v) // 2 + 1]) >= 0.5 * (v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1]) AS by_range, last < q1 - 1.5 * (q3 - q1) OR last > q3 + 1.5 * (q3 - q1) AS by_fence FROM g""")
def quartile_gates(m: Market) -> DataFrame:
    g = m.spread.groupBy("pair").agg(F.percentile("s", 0.25).alias("p25"), F.percentile("s", 0.75).alias("p75"), F.max_by("s", "t").alias("last"))
    g = g.join(stats.index_quartiles(m.spread, "pair", "s"), "pair")
    by_range = F.abs(F.col("last") - F.col("med")) >= 0.5 * (F.col("q3") - F.col("q1"))
    return g.select("pair", by_range.alias("by_range"), signals.tukey(F.col("last"), F.col("p25"), F.col("p75")).alias("by_fence"))


LOCKS = """g AS (SELECT pair, count(*) AS n, arg_max(s, t) AS last, (arg_max(s, t) - avg(s)) / stddev_pop(s) AS z FROM spread GROUP BY pair),
r AS (SELECT g.pair, g.n, z, e.b < 0 AND e.b / e.se <= -1.64 AS ecm, abs(z) >= 1 AS wide, g.n >= 600 AS enough FROM g JOIN e ON g.pair = e.pair)"""


def locks(m: Market) -> DataFrame:
    fit = stats.ols(m.steps, "pair", "x", "d").select("pair", "b", "t")
    g = stats.describe(m.spread, "pair", "s")
    ecm = (F.col("b") < 0) & (F.col("t") <= -1.64)
    return g.join(fit, "pair").select("pair", "n", "z", ecm.alias("ecm"), (F.abs("z") >= 1).alias("wide"), (F.col("n") >= 600).alias("enough"))


@add("g13_locks", f"WITH {OLS}, {LOCKS} SELECT pair, round(z, 6) AS z, ecm, wide, enough, ecm AND wide AND enough AS ready, CASE WHEN ecm AND wide AND enough THEN CASE WHEN z > 0 THEN 'SHORT' ELSE 'LONG' END ELSE 'FLAT' END AS side FROM r")
def lock_set(m: Market) -> DataFrame:
    ready = F.forall(F.array("ecm", "wide", "enough"), lambda x: x)
    side = F.when(ready, F.when(F.col("z") > 0, "SHORT").otherwise("LONG")).otherwise("FLAT")
    return locks(m).select("pair", r6("z").alias("z"), "ecm", "wide", "enough", ready.alias("ready"), side.alias("side"))


@add("t2_ranked_pairs", f"WITH {OLS}, {LOCKS} SELECT pair, round(z, 6) AS z, row_number() OVER (ORDER BY enough DESC, abs(round(z, 6)) DESC, pair) AS place FROM r")
def ranked(m: Market) -> DataFrame:
    # one row per pair
    place = F.row_number().over(Window.orderBy(F.desc("enough"), F.desc(F.abs(r6("z"))), "pair")).cast("long")
    return locks(m).select("pair", r6("z").alias("z"), place.alias("place"))


@add("a30_inverse_weights", f"WITH {OLS}, {LOCKS} SELECT pair, round(1 / greatest(1e-9, abs(z)) / sum(1 / greatest(1e-9, abs(z))) OVER (), 6) AS weight FROM r")
def weights(m: Market) -> DataFrame:
    return stats.inverse_weights(locks(m), "z").select("pair", r6("weight").alias("weight"))


@add("g29_order_rows", f"""WITH {OLS}, {LOCKS}, o AS (SELECT pair, CASE WHEN z > 0 THEN 'sell' ELSE 'buy' END AS s1, CASE WHEN z > 0 THEN 'buy' ELSE 'sell' END AS s2 FROM r)
SELECT pair, CAST(1 AS INTEGER) AS leg, split_part(pair, '-', 1) AS instr, s1 AS side, 'logged' AS status FROM o UNION ALL SELECT pair, 2, split_part(pair, '-', 2), s2, 'logged' FROM o""")
def order_rows(m: Market) -> DataFrame:
    """Two dry rows per signal; there is no live path."""
    names, short = F.split("pair", "-"), F.col("z") > 0
    legs = F.array(*[F.struct(F.lit(i + 1).alias("leg"), names[i].alias("instr"), F.when(short == F.lit(i == 0), "sell").otherwise("buy").alias("side")) for i in range(2)])
    return locks(m).select("pair", F.explode(legs).alias("l")).select("pair", "l.leg", "l.instr", "l.side", F.lit("logged").alias("status"))


@add("g17_resample_ladder", """
WITH lad AS (SELECT k, a.instr || '-' || b.instr AS pair, a.t, a.close - b.close AS s FROM (SELECT k, instr, time_bucket(to_minutes(60 * k), t) AS t, arg_max(close, t) AS close FROM bars, (SELECT unnest([1, 2, 4, 8]) AS k) GROUP BY ALL) a JOIN
 (SELECT k AS k2, instr, time_bucket(to_minutes(60 * k), t) AS t, arg_max(close, t) AS close FROM bars, (SELECT unnest([1, 2, 4, 8]) AS k) GROUP BY ALL) b ON a.t = b.t AND a.k = b.k2 AND a.instr < b.instr),
q AS (SELECT k, pair, t, s, lag(s) OVER (PARTITION BY k, pair ORDER BY t) AS x FROM lad)
SELECT CAST(k * 60 AS INTEGER) AS minutes, pair, count(x) AS n, round(regr_slope(s - x, x), 6) AS gamma FROM q GROUP BY ALL""")
def ladder(m: Market) -> DataFrame:
    out = None
    for k in (1, 2, 4, 8):
        width = k * m.scale.bar
        b = m.bars.groupBy("instr", F.window("t", f"{width} minutes").start.alias("t")).agg(F.max_by("close", "t").alias("close"))
        x, y = b.select(F.col("instr").alias("a"), "t", F.col("close").alias("ac")), b.select(F.col("instr").alias("b"), "t", F.col("close").alias("bc"))
        s = x.join(y, "t").where("a < b").select(F.concat_ws("-", "a", "b").alias("pair"), "t", (F.col("ac") - F.col("bc")).alias("s"))
        s = s.withColumn("x", F.lag("s").over(Window.partitionBy("pair").orderBy("t"))).withColumn("d", F.col("s") - F.col("x"))
        fit = stats.ols(s, "pair", "x", "d").select(F.lit(width).alias("minutes"), "pair", "n", r6("b").alias("gamma"))
        out = fit if out is None else out.unionByName(fit)
    return out


@add("f27_brief", f"""WITH {OLS}, {LOCKS} SELECT pair, concat_ws('; ', CASE WHEN abs(z) >= 2 THEN 'spread is stretched' ELSE 'spread is near its mean' END, CASE WHEN ecm THEN 'reverts' END, CASE WHEN enough THEN NULL ELSE 'few bars' END) AS brief FROM r""")
def brief(m: Market) -> DataFrame:
    text = F.concat_ws("; ", F.when(F.abs("z") >= 2, "spread is stretched").otherwise("spread is near its mean"), F.when(F.col("ecm"), "reverts"), F.when(~F.col("enough"), "few bars"))
    return locks(m).select("pair", text.alias("brief"))


@add("a18_unit_root")
def unit_root(m: Market) -> DataFrame:
    return models.adf(sessions.longest(m.spread, "pair"), "pair", "t", "s")


@add("g21_posterior_summary")
def posterior(m: Market) -> DataFrame:
    return models.posterior_summary(models.posterior(m.steps, "pair", "t", "x", "d"), "pair")


@add("g20_posterior_draws")
def posterior_draws(m: Market) -> DataFrame:
    """Every kept draw of intercept, slope and variance of the change on the level."""
    return models.posterior(m.steps, "pair", "t", "x", "d").select("pair", "draw", "alpha", "gamma", "s2")


@add("g23_walk_forward")
def walk_forward(m: Market) -> DataFrame:
    return models.walk_forward(m.steps, "pair", "t", "x", "d")


@add("g19_trader_seeds")
def traders(m: Market) -> DataFrame:
    return models.seed_summary(models.train_traders(m.steps, "pair", "t", "d"), "pair")
