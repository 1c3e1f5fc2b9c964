"""Whole records of a pair: signal, readiness, diary, strategies, predictive power, seams of contracts, wide series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions.columns import r6
from spreadloom.operators import book, roll, signals, stats
from spreadloom.plans import series, trading
from spreadloom.plans.desk import ROLLS, roll_events
from spreadloom.plans.market import SPEC, Catalog, Market
from spreadloom.plans.surface import walk_sql
from spreadloom.plans.trading import LEVEL, SCORED, flow_sql, scored

catalog = Catalog()
add = catalog.add

PAIRS = [f"{a[0]}-{b[0]}" for a in SPEC for b in SPEC if a[0] < b[0]]


@add("k14_wide_cumulative", "WITH x AS (SELECT pair, t, sum(d) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM steps) SELECT t, "
     + ", ".join(f"round(max(v) FILTER (pair = '{p}'), 5) AS \"{p}\"" for p in PAIRS) + " FROM x GROUP BY t")
def wide_cumulative(m: Market) -> DataFrame:
    """Cumulated steps of every pair, a column each."""
    w = Window.partitionBy("pair").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return m.steps.withColumn("v", F.round(F.sum("d").over(w), 5)).groupBy("t").pivot("pair", PAIRS).agg(F.first("v"))


@add("j13_seam_prices", f"""WITH {ROLLS}, dc AS (SELECT o_orderpriority AS instr, o_orderkey % 2 AS code, CAST(o_orderdate AS DATE) AS d, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL),
e AS (SELECT *, (year(ev.at) * 4 + quarter(ev.at)) % 2 AS to_code FROM ev)
SELECT instr, e.at, 1 - to_code AS from_code, to_code, (SELECT arg_max(close, d) FROM dc WHERE dc.instr = e.instr AND dc.code = 1 - e.to_code AND d <= e.at) AS px_from,
 (SELECT arg_min(close, d) FROM dc WHERE dc.instr = e.instr AND dc.code = e.to_code AND d >= e.at) AS px_to FROM e""")
def seam_prices(m: Market) -> DataFrame:
    """At each roll the last close of the contract that is left and the first of the one that comes; contracts are stood
    in for by odd and even orders."""
    closes = m.table("orders").groupBy(F.col("o_orderpriority").alias("instr"), (F.col("o_orderkey") % 2).alias("code"), F.to_date("o_orderdate").alias("d")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
    into = ((F.year("at") * 4 + F.quarter("at")) % 2).cast("long")
    return roll.seam_prices(roll_events(m).select("instr", "at", (1 - into).alias("from_code"), into.alias("to_code")), closes)


def leg_sigma(m: Market, lag: float = 10.0) -> DataFrame:
    """pair, sigma: what the second leg moves in `lag` seconds, from steps of one bar."""
    d = F.col("s") - F.lag("s").over(Window.partitionBy("pair", "sid").orderBy("t"))
    rms = F.sqrt(F.avg(F.col("d") * F.col("d")))
    return m.spread.select("pair", d.alias("d")).where("d is not null").groupBy("pair").agg((rms / F.sqrt(F.lit(m.scale.bar * 60.0)) * F.sqrt(F.lit(lag)) * F.sqrt(2 / F.pi())).alias("sigma"))


SIGMA = "sg AS (SELECT pair, sqrt(avg(d * d)) / sqrt(3600) * sqrt(10) * sqrt(2 / pi()) AS sigma FROM (SELECT pair, s - lag(s) OVER (PARTITION BY pair, sid ORDER BY t) AS d FROM spread) WHERE d IS NOT NULL GROUP BY pair)"


@add("w24_leg_risk", f"WITH {SIGMA} SELECT pair, round(sigma, 6) AS leg_sigma FROM sg")
def leg_risk(m: Market) -> DataFrame:
    return leg_sigma(m).select("pair", r6("sigma").alias("leg_sigma"))


INDICATORS = ("obi", "obi_levels", "voi", "mlofi", "tilt")


@add("g24_predictive_power", f"""WITH {LEVEL}, p AS (SELECT *, lag(bids) OVER (PARTITION BY instr ORDER BY t) AS ob, lag(asks) OVER (PARTITION BY instr ORDER BY t) AS oa,
 list_sum([bids[i].qty / i FOR i IN [1, 2, 3, 4, 5]]) AS wb, list_sum([asks[i].qty / i FOR i IN [1, 2, 3, 4, 5]]) AS wa FROM lv),
f AS (SELECT instr, t, t + INTERVAL '60 seconds' AS due, mid, CASE WHEN bq + aq = 0 THEN 0 ELSE (bq - aq) / (bq + aq) END AS obi, CASE WHEN wb + wa = 0 THEN 0 ELSE (wb - wa) / (wb + wa) END AS obi_levels,
 CASE WHEN ob IS NOT NULL THEN {flow_sql(1)} END AS voi, CASE WHEN ob IS NOT NULL THEN {' + '.join(flow_sql(i) for i in range(1, 6))} END AS mlofi,
 CASE WHEN bq + aq = 0 THEN 0 ELSE (bq * ap + aq * bp) / (bq + aq) - mid END AS tilt FROM p),
j AS (SELECT f.*, q.mid - f.mid AS y FROM f ASOF JOIN f q ON f.instr = q.instr AND f.due <= q.t), l AS ({' UNION ALL '.join(f"SELECT instr, '{x}' AS name, {x} AS x, y FROM j WHERE {x} IS NOT NULL" for x in INDICATORS)})
SELECT instr, name, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN corr(x, y) END, 5) AS corr FROM l GROUP BY ALL""")
def predictive(m: Market) -> DataFrame:
    """Correlation of five indicators of a book with the change of its mid to the first book a minute later."""
    rows = book.features(m.quotes, ["instr"]).select("instr", "t", "mid", *INDICATORS)
    return book.predictive(rows, "instr", list(INDICATORS), 1).withColumn("corr", F.round("corr", 5))


@add("g15_signal_record", """
WITH k AS (SELECT pair, t, ln(a_close) AS la, ln(b_close) AS lb, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM aligned), f AS (SELECT pair, coalesce(regr_slope(la, lb), 1) AS beta FROM k WHERE k <= 120 GROUP BY pair),
s AS (SELECT k.pair, t, la, lb, beta, la - beta * lb AS s FROM k JOIN f ON k.pair = f.pair WHERE k <= 120),
g AS (SELECT pair, count(*) AS n, any_value(beta) AS beta, (arg_max(s, t) - avg(s)) / stddev_pop(s) AS z, list_sort(list(s)) AS v, arg_max(s, t) AS last, max(t) AS last_t FROM s GROUP BY pair),
h AS (SELECT *, coalesce(round(CASE WHEN v[3 * n // 4 + 1] - v[n // 4 + 1] > 1e-12 THEN (last - v[n // 2 + 1]) / (v[3 * n // 4 + 1] - v[n // 4 + 1]) END, 5), 0) AS iqr_pos FROM g),
q AS (SELECT pair, t, s, lag(s) OVER w AS x, la - lag(la) OVER w AS ra, lb - lag(lb) OVER w AS rb FROM s WINDOW w AS (PARTITION BY pair ORDER BY t)), st AS (SELECT pair, t, x, s - x AS d FROM q WHERE x IS NOT NULL),
fe AS (SELECT pair, count(*) AS n, regr_slope(d, x) AS b, regr_intercept(d, x) AS a, regr_sxx(d, x) AS sxx, avg(x) AS mx FROM st GROUP BY pair),
u AS (SELECT st.pair, st.t, (x - mx) * (d - a - b * x) AS u, greatest(1, CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INTEGER)) AS m FROM st JOIN fe ON st.pair = fe.pair), i AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS k FROM u),
pp AS (SELECT i.pair, sum(CASE WHEN j.k = i.k THEN 1 ELSE 2 * (1 - (i.k - j.k) / (i.m + 1.0)) END * i.u * j.u) AS ss FROM i JOIN i j ON i.pair = j.pair AND j.k BETWEEN i.k - i.m AND i.k GROUP BY i.pair),
c AS (SELECT fe.pair, round(b, 5) AS gamma, round(b * sxx / sqrt(ss), 5) AS t_hac FROM fe JOIN pp ON fe.pair = pp.pair),
r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS kk FROM q WHERE ra IS NOT NULL),
ll AS (SELECT x.pair, y.kk - x.kk AS lag, coalesce(corr(x.ra, y.rb), 0) AS c FROM r x JOIN r y ON x.pair = y.pair AND y.kk - x.kk BETWEEN -10 AND 10 GROUP BY ALL),
lo AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(abs(c), 9) DESC, CASE WHEN lag > 0 THEN 2 * lag - 1 ELSE -2 * lag END) AS o FROM ll),
o AS (SELECT h.*, round(h.z, 5) AS zz, gamma, t_hac, lo.lag, lo.c, abs(iqr_pos) >= 0.5 AS gate_iqr, coalesce(gamma < 0 AND t_hac <= -1.64, false) AS gate_ecm FROM h JOIN c ON h.pair = c.pair JOIN lo ON lo.pair = h.pair AND lo.o = 1)
SELECT pair, n, round(beta, 5) AS beta, zz AS z, iqr_pos, gamma AS ecm_gamma, t_hac AS ecm_t, CAST(lag AS INTEGER) AS lead_lag, round(c, 5) AS lead_corr, gate_iqr, gate_ecm,
 CASE WHEN gate_iqr AND gate_ecm AND zz >= 1 THEN 'SHORT_SPREAD' WHEN gate_iqr AND gate_ecm AND zz <= -1 THEN 'LONG_SPREAD' ELSE 'NONE' END AS signal, last_t FROM o""")
def signal_record(m: Market, rows: int = 120, threshold: float = 1.0, fence: float = 1.0, gate: bool = True) -> DataFrame:
    """Per pair over its latest `rows` bars: hedge ratio, score, place in the quartile range, error correction with a HAC t
    of automatic lags, lead and lag of the legs, both gates, the signal."""
    own = stats.tail(m.aligned.select("pair", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb")), ["pair"], "t", rows)
    fit = stats.ols(own, "pair", "lb", "la").select("pair", F.coalesce("b", F.lit(1.0)).alias("beta"))
    s = own.join(fit, "pair").withColumn("s", F.col("la") - F.col("beta") * F.col("lb"))
    w = Window.partitionBy("pair").orderBy("t")
    q = s.select("pair", "t", F.lag("s").over(w).alias("x"), "s", (F.col("la") - F.lag("la").over(w)).alias("ra"), (F.col("lb") - F.lag("lb").over(w)).alias("rb")).where("x is not null")
    ecm = stats.hac(q.withColumn("d", F.col("s") - F.col("x")), "pair", "t", "x", "d", lags=None)
    lead = stats.lead_lag(q, "pair", "t", "ra", "rb", 10)
    out = stats.describe(s, "pair", "s").join(stats.index_quartiles(s, "pair", "s").drop("n"), "pair").join(fit, "pair")
    out = out.join(ecm.select("pair", F.round("b", 5).alias("ecm_gamma"), F.round("t_hac", 5).alias("ecm_t")), "pair").join(lead, "pair").join(s.groupBy("pair").agg(F.max("t").alias("last_t")), "pair")
    span = F.col("q3") - F.col("q1")
    out = out.withColumn("z", F.round("z", 5)).withColumn("iqr_pos", F.coalesce(F.round(F.when(span > 1e-12, (F.col("last") - F.col("med")) / span), 5), F.lit(0.0)))
    out = out.withColumn("gate_iqr", F.lit(fence <= 0) | (F.abs("iqr_pos") >= fence * 0.5))
    out = out.withColumn("gate_ecm", F.lit(not gate) | F.coalesce((F.col("ecm_gamma") < 0) & (F.col("ecm_t") <= -1.64), F.lit(False)))
    open_ = F.col("gate_iqr") & F.col("gate_ecm")
    signal = F.when(open_ & (F.col("z") >= threshold), "SHORT_SPREAD").when(open_ & (F.col("z") <= -threshold), "LONG_SPREAD").otherwise("NONE")
    return out.select("pair", "n", F.round("beta", 5).alias("beta"), "z", "iqr_pos", "ecm_gamma", "ecm_t", F.col("lag").alias("lead_lag"), F.round("corr", 5).alias("lead_corr"), "gate_iqr", "gate_ecm", signal.alias("signal"), "last_t")


@add("g16_beta_readiness", """WITH b AS (SELECT pair, t, CASE WHEN count(*) OVER w >= 30 THEN regr_slope(ln(a_close), ln(b_close)) OVER w END AS beta FROM pair_bars WINDOW w AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM b WHERE beta IS NOT NULL), g AS (SELECT pair, count(*) AS n_beta, CASE WHEN count(*) >= 60 THEN stddev_pop(beta) FILTER (k <= 60) END AS sd, arg_max(beta, t) AS last FROM k GROUP BY pair),
se AS (SELECT pair, sid, count(*) AS n, date_diff('minute', min(t), max(t)) AS active FROM pair_bars GROUP BY ALL), a AS (SELECT pair, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / greatest(sum(active), 1), 4) AS rate FROM se GROUP BY pair),
x AS (SELECT pair, count(*) AS fx_overlap FROM aligned x JOIN bars f ON x.t = f.t AND f.instr = 'purchase' GROUP BY pair),
r AS (SELECT a.pair, a.n, rate, coalesce(n_beta, 0) AS n_beta, sd, last, coalesce(fx_overlap, 0) AS fx_overlap, a.n >= 640 AS enough, coalesce(sd <= 0.1, false) AS stable FROM a LEFT JOIN g ON a.pair = g.pair LEFT JOIN x ON a.pair = x.pair)
SELECT pair, n, n_beta, round(sd, 5) AS sd, rate, CASE WHEN NOT enough AND rate > 0 THEN CAST(floor((640 - n) / rate) AS BIGINT) END AS eta_minutes, fx_overlap, enough AND stable AS ready, round(CASE WHEN enough AND stable THEN last ELSE 1.0 END, 5) AS beta,
 'sample ' || CASE WHEN enough THEN 'ok' ELSE 'short' END || '; stability ' || CASE WHEN stable THEN 'ok' ELSE 'short' END || '; rates ' || CASE WHEN fx_overlap > 0 THEN 'ok' ELSE 'short' END AS checklist FROM r""")
def beta_readiness(m: Market, least: int = 640, most_sd: float = 0.1) -> DataFrame:
    """Whether a pair's rolling hedge ratio may be used: sample and its rate, minutes until it is large enough, spread of
    the latest 60 ratios, overlap with the rates, a checklist; 1 stands for a ratio that may not."""
    logs = m.pair_bars.select("pair", "sid", "t", F.ln("a_close").alias("la"), F.ln("b_close").alias("lb"))
    b = stats.rolling_beta(logs, ["pair", "sid"], "t", "lb", "la", 60, 30).where("beta is not null").withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("t"))))
    g = b.groupBy("pair").agg(F.count("*").alias("n_beta"), F.when(F.count("*") >= 60, F.stddev_pop(F.when(F.col("k") <= 60, F.col("beta")))).alias("sd"), F.max_by("beta", "t").alias("last"))
    active = F.timestamp_diff("MINUTE", F.min("t"), F.max("t"))
    a = m.pair_bars.groupBy("pair", "sid").agg(F.count("*").alias("n"), active.alias("active")).groupBy("pair").agg(
        F.sum("n").alias("n"), F.round(F.sum("n") / F.greatest(F.sum("active"), F.lit(1)), 4).alias("rate"))
    fx = m.aligned.join(m.bars.where("instr = 'purchase'").select("t"), "t").groupBy("pair").agg(F.count("*").alias("fx_overlap"))
    out = a.join(g, "pair", "left").join(fx, "pair", "left").na.fill(0, ["n_beta", "fx_overlap"])
    enough, stable, rates = F.col("n") >= least, F.coalesce(F.col("sd") <= most_sd, F.lit(False)), F.col("fx_overlap") > 0
    says = lambda name, ok: F.concat(F.lit(f"{name} "), F.when(ok, "ok").otherwise("short"))
    return out.select(
        "pair", "n", "n_beta", F.round("sd", 5).alias("sd"), "rate", F.when(~enough & (F.col("rate") > 0), F.floor((least - F.col("n")) / F.col("rate"))).alias("eta_minutes"), "fx_overlap",
        (enough & stable).alias("ready"), F.round(F.when(enough & stable, F.col("last")).otherwise(1.0), 5).alias("beta"), F.concat_ws("; ", says("sample", enough), says("stability", stable), says("rates", rates)).alias("checklist"))


@add("g30_verdict_diary", """
WITH st AS (SELECT pair, strftime(date_trunc('week', t), '%Y-%m-%d') AS label, t, x, d FROM steps UNION ALL SELECT pair, 'now', t, x, d FROM steps),
f AS (SELECT pair, label, count(*) AS n, regr_slope(d, x) AS b, regr_intercept(d, x) AS a, regr_sxx(d, x) AS sxx, avg(x) AS mx FROM st GROUP BY ALL),
u AS (SELECT st.pair, st.label, (x - mx) * (d - a - b * x) AS u, row_number() OVER (PARTITION BY st.pair, st.label ORDER BY t) AS k FROM st JOIN f ON st.pair = f.pair AND st.label = f.label),
p AS (SELECT i.pair, i.label, sum(CASE WHEN j.k = i.k THEN 1 ELSE 2 * (1 - (i.k - j.k) / 11.0) END * i.u * j.u) AS s FROM u i JOIN u j ON i.pair = j.pair AND i.label = j.label AND j.k BETWEEN i.k - 10 AND i.k GROUP BY ALL),
r AS (SELECT f.pair, f.label, n, round(CASE WHEN b > -1 AND b < 0 THEN ln(2) / -ln(1 + b) END, 4) AS half_life, round(CASE WHEN n >= 3 AND sxx > 0 AND s > 0 THEN b * sxx / sqrt(s) END, 5) AS t_hac FROM f JOIN p ON f.pair = p.pair AND f.label = p.label)
SELECT *, CASE WHEN t_hac <= -1.64 THEN 'pass' ELSE 'fail' END AS verdict FROM r""")
def diary(m: Market) -> DataFrame:
    """A dated row per pair and week, and one of the whole sample: bars, half-life, HAC t, verdict."""
    week = F.date_format(F.date_trunc("week", "t"), "yyyy-MM-dd")
    steps = m.steps.select("pair", "t", "x", "d", F.explode(F.array(week, F.lit("now"))).alias("label")).withColumn("key", F.concat_ws("|", "pair", "label"))
    fit = stats.hac(steps, "key", "t", "x", "d").select("key", "n", "b", F.round("t_hac", 5).alias("t_hac"))
    names = F.split("key", "[|]")
    half = F.when((F.col("b") > -1) & (F.col("b") < 0), F.round(F.ln(F.lit(2.0)) / -F.ln(1 + F.col("b")), 4))
    return fit.select(names[0].alias("pair"), names[1].alias("label"), "n", half.alias("half_life"), "t_hac", F.when(F.col("t_hac") <= -1.64, "pass").otherwise("fail").alias("verdict"))


def fills_sql(positions: str, keys: str) -> str:
    """Trades tr (keys, pair, delta, px, decision) of `positions` (keys, pair, sid, t, pos)."""
    own = "".join(f"po.{k}, " for k in keys.split(", ") if k)
    bare = "".join(f"{k}, " for k in keys.split(", ") if k)
    return f"""po AS ({positions}),
l AS (SELECT po.*, b.a_open - b.b_open AS open, b.s AS close, coalesce(lag(pos) OVER o, 0) AS old, lead(b.a_open - b.b_open) OVER o AS px, row_number() OVER o AS r, count(*) OVER (PARTITION BY {own}po.pair, po.sid) AS n
 FROM po JOIN spread b ON b.pair = po.pair AND b.sid = po.sid AND b.t = po.t WINDOW o AS (PARTITION BY {own}po.pair, po.sid ORDER BY po.t)),
tr AS (SELECT {bare}pair, pos - old AS delta, px, close AS decision FROM l WHERE r < n AND pos <> old UNION ALL SELECT {bare}pair, -old, open, NULL FROM l WHERE r = n AND old <> 0)"""


@add("a25_strategy_metrics", f"""WITH RECURSIVE {walk_sql('[2.0::DOUBLE]')}, {SIGMA}, c AS (SELECT pair, t, r, sum(r) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM r), dr AS (SELECT *, v - max(v) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS dd FROM c),
q AS (SELECT pair, count(*) FILTER (r > 0) AS wins, round(CASE WHEN sum(r * r) > 0 THEN avg(r) / sqrt(avg(r * r)) * sqrt(252.0 * 400) END, 5) AS ratio, round(min(dd), 5) AS drawdown FROM dr GROUP BY pair),
{fills_sql('SELECT pair, sid, t, pos FROM w', '')},
x AS (SELECT tr.pair, count(*) AS fills, -sum(px * delta) AS gross, sum(abs(delta)) * 0.012::DOUBLE AS cost, sum(abs(delta)) * any_value(sigma) AS leg, sum(coalesce((px - decision) * delta, 0)) AS shortfall FROM tr JOIN sg ON tr.pair = sg.pair GROUP BY tr.pair)
SELECT q.pair, coalesce(fills, 0) AS fills, round(gross, 5) AS gross, round(cost, 5) AS cost, round(leg, 5) AS leg_risk, round(shortfall, 5) AS shortfall, round(gross - cost - leg, 5) AS net, wins, ratio, drawdown FROM q LEFT JOIN x ON q.pair = x.pair""")
def strategy_metrics(m: Market) -> DataFrame:
    """Per pair, for reversion positions: fills, gross, cost, leg risk, shortfall, net; winning steps, ratio and drawdown of
    the positions marked to market."""
    z = scored(m)
    pos = signals.held(z, ["pair", "sid"], "t", "z", 2.0, 0.25)
    w = Window.partitionBy("pair", "sid").orderBy("t")
    rows = z.select("pair", "sid", "t", "s", (F.col("a_open") - F.col("b_open")).alias("open")).join(pos, ["pair", "sid", "t"])
    steps = rows.withColumn("r", F.coalesce(F.lag("pos").over(w) * (F.col("s") - F.lag("s").over(w)), F.lit(0.0)))
    rms = F.sqrt(F.avg(F.col("r") * F.col("r")))
    marked = stats.drawdown(steps, ["pair"], "t", "r").groupBy("pair").agg(
        F.count_if(F.col("r") > 0).alias("wins"), F.round(F.try_divide(F.avg("r"), rms) * F.sqrt(F.lit(252.0 * 400)), 5).alias("ratio"), F.round(F.min("drawdown"), 5).alias("drawdown"))
    filled = signals.fills(rows.withColumnRenamed("s", "close").join(leg_sigma(m), "pair").select("sigma", "pair", "sid", "t", "open", "close", "pos"), ["sigma", "pair", "sid"], "t", F.lit(0.01), 0.004, F.col("sigma"))
    out = marked.join(signals.results(filled, ["pair"]), "pair", "left")
    r5 = lambda c, name: F.round(c, 5).alias(name)
    return out.select("pair", F.coalesce("fills", F.lit(0)).alias("fills"), r5("gross", "gross"), r5("cost", "cost"), r5("leg_cost", "leg_risk"), r5("shortfall", "shortfall"), r5("net", "net"), "wins", "ratio", "drawdown")


CROSS = """mc AS (SELECT pair, sid, t, CASE WHEN count(*) OVER l < 60 THEN 0 ELSE CAST(sign(round(avg(s) OVER k - avg(s) OVER l, 9)) AS INTEGER) END AS pos FROM spread
WINDOW l AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), k AS (PARTITION BY pair, sid ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@add("g32_strategy_table", f"""WITH RECURSIVE {SCORED}, {SIGMA}, {CROSS},
st AS (SELECT * FROM (VALUES ('reversion', 2.0, 0.25, false), ('band', 2.0, 0.0, true), ('wide', 1.0, 0.3, false)) v(strategy, enter, leaves, crosses)),
w AS (SELECT strategy, enter, leaves, crosses, pair, sid, t, k, CASE WHEN abs(z) >= enter THEN -CAST(sign(z) AS INTEGER) ELSE 0 END AS pos FROM sc, st WHERE k = 1
UNION ALL SELECT w.strategy, w.enter, w.leaves, w.crosses, x.pair, x.sid, x.t, x.k, CASE WHEN x.z IS NULL THEN w.pos WHEN w.pos = 0 AND abs(x.z) >= w.enter THEN -CAST(sign(x.z) AS INTEGER)
 WHEN w.pos <> 0 AND CASE WHEN w.crosses THEN x.z * w.pos >= 0 ELSE abs(x.z) <= w.leaves END THEN 0 ELSE w.pos END FROM w JOIN sc x ON x.pair = w.pair AND x.sid = w.sid AND x.k = w.k + 1),
{fills_sql("SELECT strategy, pair, sid, t, pos FROM w UNION ALL SELECT 'momentum', pair, sid, t, -pos FROM w WHERE strategy = 'reversion' UNION ALL SELECT 'cross', pair, sid, t, pos FROM mc UNION ALL SELECT 'hold', pair, sid, t, 1 FROM spread", 'strategy')},
g AS (SELECT tr.pair, profile, strategy, count(*) AS fills, -sum(px * delta) AS gross, -sum(px * delta) - sum(abs(delta) * (half + 0.004 / 2)) - sum(abs(delta) * sigma) AS net FROM tr JOIN sg ON tr.pair = sg.pair, (VALUES ('cheap', 0.005::DOUBLE), ('dear', 0.05::DOUBLE)) v(profile, half) GROUP BY ALL)
SELECT pair, profile, strategy, fills, round(gross, 5) AS gross, round(net, 5) AS net, row_number() OVER (PARTITION BY pair, profile ORDER BY net DESC, strategy) AS place FROM g""")
def strategy_table(m: Market) -> DataFrame:
    """Six signals by two cost profiles with the pair's own leg risk, ranked by net per pair."""
    z, keys = scored(m), ["pair", "sid"]
    px = z.select(*keys, "t", (F.col("a_open") - F.col("b_open")).alias("open"), F.col("s").alias("close"))
    long, short = stats.frame(keys, "t", 60), stats.frame(keys, "t", 20)
    side = F.signum(F.round(F.avg("s").over(short) - F.avg("s").over(long), 9)).cast("int")
    back = signals.held(z, keys, "t", "z", 2.0, 0.25)
    named = {
        "reversion": back, "band": signals.held(z, keys, "t", "z", 2.0, 0.0, cross=True), "wide": signals.held(z, keys, "t", "z", 1.0, 0.3), "momentum": back.withColumn("pos", -F.col("pos")),
        "cross": m.spread.select(*keys, "t", F.when(F.count("*").over(long) < 60, 0).otherwise(side).alias("pos")), "hold": px.select(*keys, "t", F.lit(1).alias("pos")),
    }
    pos = reduce(DataFrame.unionByName, [p.withColumn("strategy", F.lit(n)) for n, p in named.items()])
    costs = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(h).alias("half")) for n, h in (("cheap", 0.005), ("dear", 0.05))]))
    rows = px.join(pos, [*keys, "t"]).join(leg_sigma(m), "pair").select("*", costs.alias("p")).select("strategy", "p.profile", "p.half", "sigma", *keys, "t", "open", "close", "pos")
    out = signals.results(signals.fills(rows, ["strategy", "profile", "half", "sigma", *keys], "t", F.col("half"), 0.004, F.col("sigma")), ["pair", "profile", "strategy"])
    place = F.row_number().over(Window.partitionBy("pair", "profile").orderBy(F.desc("net"), "strategy"))
    return out.select("pair", "profile", "strategy", "fills", F.round("gross", 5).alias("gross"), F.round("net", 5).alias("net"), place.cast("long").alias("place"))


@add("x_live_board", f"""WITH pr AS ({{report}}) SELECT '{{{{"pair":"' || pair || '","z":"' || printf('%.4f', z) || '"' || coalesce(',"half_life":"' || printf('%.2f', half_life) || '"', '') || coalesce(',"t_hac":"' || printf('%.3f', t_hac) || '"', '') || '}}}}' AS payload
FROM (SELECT * FROM pr WHERE z IS NOT NULL ORDER BY abs(z) DESC, pair LIMIT 8)""".format(report=series.PAIR_REPORT))
def live_board(m: Market) -> DataFrame:
    """The eight pairs with the widest scores, as messages for a board."""
    top = series.pair_report(m).where("z is not null").orderBy(F.desc(F.abs("z")), "pair").limit(8)
    said = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, c)).alias(c)
    return top.select(F.to_json(F.struct("pair", said("z", "%.4f"), said("half_life", "%.2f"), said("t_hac", "%.3f"))).alias("payload"))
