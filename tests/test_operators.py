"""Hand-made series with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadloom.functions import columns as c
from spreadloom.operators import align, bars, book, merge, models, quality, roll, sessions, signals, stats

T0 = dt.datetime(2024, 1, 2, 9)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def series(spark, values, step=1, key="k"):
    return spark.createDataFrame([(key, at(i * step), float(v)) for i, v in enumerate(values)], "k string, t timestamp_ntz, x double")


def test_gap_of_exactly_an_hour_does_not_split(spark):
    df = spark.createDataFrame([("k", at(m)) for m in (0, 60, 121)], "k string, t timestamp_ntz")
    assert [r.sid for r in sessions.sessionize(df, ["k"], "t", 60).orderBy("t").collect()] == [0, 0, 1]


def test_steps_of_ninety_seconds_count_and_longer_ones_do_not(spark):
    df = spark.createDataFrame([("k", at(0, s), float(s)) for s in (0, 60, 150, 241)], "k string, t timestamp_ntz, x double")
    got = sessions.consecutive(df.withColumnRenamed("x", "v"), ["k"], "t", "v", 1.5).orderBy("t").collect()
    assert [(r.x, r.d) for r in got] == [(0.0, 60.0), (60.0, 90.0)]


def test_exact_autoregression(spark):
    x = [64 * 0.5**i for i in range(8)]
    rows = spark.createDataFrame([("k", a, b) for a, b in zip(x, x[1:], strict=False)], "k string, x double, y double")
    r = stats.reversion(stats.ols(rows, "k", "x", "y")).first()
    assert r.b == pytest.approx(0.5) and r.half_life == pytest.approx(1.0)


def test_constant_series_gives_nulls_not_errors(spark):
    df = series(spark, [3.0] * 40)
    assert stats.describe(df, "k", "x").first().z is None
    assert stats.ols(df.withColumn("y", F.col("x")), "k", "x", "y").first().b is None
    assert {r.r_z for r in stats.rolling(df, ["k"], "t", "x", 10, 5).collect()} == {None}
    assert df.agg(c.correlation(F.col("x"), F.col("x")).alias("r")).first().r is None


def test_counter_reset(spark):
    df = spark.createDataFrame([("k", at(i), 1.0, float(q)) for i, q in enumerate([10, 15, 3, 9])], "instr string, t timestamp_ntz, px double, totq double")
    assert [r.qty for r in bars.counter_sizes(df, "totq").orderBy("t").collect()] == [0.0, 5.0, 3.0, 6.0]


def test_dates_walk_back_over_midnight(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(["000100", "000000", "235900", "235800", "235900"])], "k string, i int, clock string")
    got = quality.dated(df, "k", "i", "clock", F.lit("2024-01-05").cast("date")).orderBy("i").collect()
    assert [r.day.day for r in got] == [5, 5, 4, 4, 3]


def test_weekend_batches_are_refused(spark):
    rows = [("a", dt.datetime(2024, 1, 7, 20)), ("b", dt.datetime(2024, 1, 8, 3)), ("c", dt.datetime(2024, 1, 9, 9)), ("d", None)]
    got = {r.k: r.accepted for r in quality.batches(spark.createDataFrame(rows, "k string, t timestamp_ntz"), "k", "t").collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False}


def test_asof_and_last_seen_differ_before_the_first_exact_match(spark):
    left = spark.createDataFrame([("p", at(m)) for m in (0, 2, 4)], "k string, t timestamp_ntz").withColumn("v", F.lit(1.0))
    rates = spark.createDataFrame([("p", at(1), 7.0), ("p", at(4), 8.0)], "k string, t timestamp_ntz, rate double")
    assert [r.rate for r in align.carried(left, rates, ["k"], "rate").orderBy("t").collect()] == [None, 7.0, 8.0]
    assert [r.rate for r in align.last_seen(left, rates.drop("k"), ["k"], "rate").orderBy("t").collect()] == [None, None, 8.0]
    assert [r.rate for r in align.carried(left, rates, ["k"], "rate", strict=True).orderBy("t").collect()] == [None, 7.0, 7.0]
    assert [r.rate for r in align.carried(left, rates, ["k"], "rate", forward=True).orderBy("t").collect()] == [7.0, 8.0, 8.0]
    assert [r.rate for r in align.carried(left, rates, ["k"], "rate", forward=True, strict=True).orderBy("t").collect()] == [7.0, 8.0, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=12), st.lists(st.integers(0, 40), max_size=8, unique=True))
def test_asof_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([("k", at(m), i) for i, m in enumerate(left)], "k string, t timestamp_ntz, i int")
    b = spark.createDataFrame([("k", at(m), float(m)) for m in right], "k string, t timestamp_ntz, r double")
    got = {r.i: r.r for r in align.carried(a, b, ["k"], "r").collect()}
    assert got == {i: float(max((x for x in right if x <= m), default=math.nan)) if any(x <= m for x in right) else None for i, m in enumerate(left)}


def test_hac_equals_a_plain_sum(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=60), rng.normal(size=60)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k string, t int, x double, y double")
    xc = x - x.mean()
    b = xc @ y / (xc @ xc)
    u = xc * (y - y.mean() - b * xc)
    s = u @ u + sum(2 * (1 - k / 11) * (u[k:] @ u[:-k]) for k in range(1, 11))
    assert stats.hac(df, "k", "t", "x", "y").first().t_hac == pytest.approx(b * (xc @ xc) / math.sqrt(s))
    g, t = signals.automatic_hac(np.cumsum(x))
    level = stats.hac(spark.createDataFrame([("k", i, float(a), float(d)) for i, (a, d) in enumerate(zip(np.cumsum(x)[:-1], np.diff(np.cumsum(x)), strict=True))], "k string, t int, x double, y double"), "k", "t", "x", "y", lags=None).first()
    assert (g, t) == (pytest.approx(level.b), pytest.approx(level.t_hac))


def test_rolling_beta_equals_the_direct_frame(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("k", at(i), float(a), float(a * 2 + b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))], "k string, t timestamp_ntz, x double, y double")
    got = [r.beta for r in stats.rolling_beta(df, ["k"], "t", "x", "y", 20, 5).orderBy("t").collect()]
    v = np.array([(r.x, r.y) for r in df.orderBy("t").collect()])
    for i, b in enumerate(got):
        part = v[max(0, i - 19) : i + 1]
        assert (b is None) if i < 4 else b == pytest.approx(np.polyfit(part[:, 0], part[:, 1], 1)[0])


def test_upsert_matrix(spark):
    old = spark.createDataFrame([("a", 1.0, 5.0, "s1"), ("b", 1.0, 5.0, "s1")], "k string, px double, volume double, symbol string")
    new = spark.createDataFrame([("a", 2.0, 3.0, ""), ("c", 2.0, 3.0, "s2")], old.schema)
    get = lambda **p: {r.k: (r.px, r.volume, r.symbol) for r in merge.upsert(old, new, ["k"], **p).collect()}
    rest = {"b": (1.0, 5.0, "s1"), "c": (2.0, 3.0, "s2")}
    assert get() == rest | {"a": (2.0, 3.0, "")}
    assert get(keep=("symbol",)) == rest | {"a": (2.0, 3.0, "s1")}
    assert get(keep=("symbol",), largest=("volume",)) == rest | {"a": (2.0, 5.0, "s1")}
    assert get(guard=("symbol",)) == rest | {"a": (2.0, 3.0, "s1")}
    assert sorted(r.k for r in merge.append_once(old, new.union(new), ["k"]).collect()) == ["a", "b", "c"]


def test_gaps_close_on_any_or_on_all_bars(spark):
    gaps = spark.createDataFrame([("k", at(10), at(12), 3)], "instr string, gap_from timestamp_ntz, gap_to timestamp_ntz, minutes long")
    some = spark.createDataFrame([("k", at(11))], "instr string, t timestamp_ntz")
    assert merge.close_gaps(gaps, some, False, 1).first().filled and not merge.close_gaps(gaps, some, True, 1).first().filled


def test_book_rules_and_thin_books(spark):
    lv = lambda *x: [(float(p), float(q)) for p, q in x]
    rows = [("k", at(0), lv((99, 5), (98, 5)), lv((101, 6), (102, 6))), ("k", at(1), lv((99.5, 4), (98, 5)), lv((101, 9), (102, 6))), ("k", at(2), lv((99, 7), (98, 5)), lv((100.5, 2), (102, 6)))]
    kind = "k string, t timestamp_ntz, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>"
    padded = [(k, t, b + [(1.0, 0.0)] * 3, a + [(999.0, 0.0)] * 3) for k, t, b, a in rows]
    got = book.features(spark.createDataFrame(padded, kind), ["k"], size=10).orderBy("t").collect()
    assert [r.voi for r in got] == [None, 4.0 - 3.0, 0.0 - 2.0]
    assert got[0].cost == pytest.approx(((5 * 101 + 1 * 101 + 4 * 102) / 10 - (5 * 99 + 5 * 98) / 10) / 2 / 100 * 1e4)
    assert book.features(spark.createDataFrame(padded, kind), ["k"], size=50).first().cost is None


def test_contract_calendar(spark):
    day = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(
        c.third_tuesday(day("2026-09-01")).alias("a"), c.third_tuesday(day("2026-12-20")).alias("b"), c.first_notice(day("2026-09-01")).alias("f"), c.last_trading(day("2026-09-01")).alias("e"),
        c.weekdays_between(day("2026-09-04"), day("2026-09-08")).alias("n"), c.weekdays_between(day("2026-09-08"), day("2026-09-04")).alias("m"),
        c.krx_code(F.lit("65"), day("2026-12-01")).alias("kr"), c.us_code(F.lit("ZN"), day("2026-12-01")).alias("us"), c.krx_month(F.lit("A656C000"), day("2026-09-01")).alias("km"), c.us_month(F.lit("ZNZ26")).alias("um")).first()
    assert [str(x) for x in r] == ["2026-09-15", "2026-12-15", "2026-08-31", "2026-09-08", "2", "-2", "A656C000", "ZNZ26", "2026-12-01", "2026-12-01"]


def test_roll_decision_prefers_volume(spark):
    rows = [(dt.date(2026, 9, 1), "A6569000", 10, 11), (dt.date(2026, 9, 10), "A6569000", 10, 5), (dt.date(2026, 9, 1), "A6569000", 10, None)]
    got = roll.decide(spark.createDataFrame(rows, "asof date, code string, vol_now long, vol_next long"), "KRX").collect()
    assert [(r.reason, r.next_code) for r in got] == [("volume", "A656C000"), ("calendar", "A656C000"), ("none", "A656C000")]


def test_position_path_and_forced_exit(spark):
    z = [None, 2.5, 1.0, 0.2, -2.5, None, -1.0]
    df = spark.createDataFrame([("k", at(i), v, 100.0 + i, 100.5 + i) for i, v in enumerate(z)], "k string, t timestamp_ntz, z double, open double, close double")
    pos = signals.held(df, ["k"], "t", "z", 2.0, 0.25)
    assert [r.pos for r in pos.orderBy("t").collect()] == [0, -1, -1, 0, 1, 1, 1]
    band = signals.held(df, ["k"], "t", "z", 2.0, 0.0, cross=True)
    assert [r.pos for r in band.orderBy("t").collect()] == [0, -1, -1, -1, 0, 0, 0]
    trades = signals.fills(df.join(pos, ["k", "t"]), ["k"], "t", F.lit(0.1), 0.2, F.lit(0.0)).orderBy("t").collect()
    assert [(r.delta, r.px, r.forced) for r in trades] == [(-1, 102.0, False), (1, 104.0, False), (1, 105.0, False), (-1, 106.0, True)]
    out = signals.results(spark.createDataFrame(trades), ["k"]).first()
    assert (out.gross, out.cost, out.net) == (pytest.approx(-1.0), pytest.approx(0.8), pytest.approx(-1.8))


def test_backtest_by_hand():
    s = np.array([0, 1, 0, 1, 0, 1, 5, 0.5, 0.5])
    z = signals.history(s, 6)[0]
    trips = signals.round_trips(z, lambda i: True, np.flatnonzero(np.abs(z) >= 2.0))
    assert len(trips) == 1 and signals.gains(s[6:], trips) == pytest.approx([4.5]) and signals.running(s[6:], trips)[-1] == pytest.approx(4.5)
    assert len(signals.round_trips(z, lambda i: True, np.flatnonzero(np.abs(z) >= 50.0))) == 0


def test_unit_root_surface_and_power():
    assert models.p_value(-0.699) == pytest.approx(0.847, abs=1e-3) and models.p_value(-1.494) == pytest.approx(0.5365, abs=1e-3)
    assert models.p_value(9.0) == 1.0 and models.p_value(-30.0) == 0.0
    rng = np.random.default_rng(3)
    assert models.unit_root(rng.normal(size=400))[1] < 0.01 < 0.1 < models.unit_root(np.cumsum(np.random.default_rng(5).normal(size=400)))[1]
    assert math.isnan(models.unit_root(np.ones(50))[0]) and math.isnan(models.unit_root(np.ones(2))[0])


def test_gibbs_recovers_coefficients():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    b, s2 = models.gibbs(x, x @ [0.5, -0.3] + rng.normal(size=400), 1200, 200, 1)
    assert b.mean(axis=0) == pytest.approx([0.5, -0.3], abs=0.12) and s2.mean() == pytest.approx(1.0, abs=0.2)
    again, _ = models.gibbs(x, x @ [0.5, -0.3], 50, 10, 1)
    assert (again == models.gibbs(x, x @ [0.5, -0.3], 50, 10, 1)[0]).all()


def test_intervals_merge_and_cover(spark):
    stamps = spark.createDataFrame([(at(m),) for m in (0, 10, 40, 1500)], "t timestamp_ntz")
    spans = sessions.merged(stamps, "t", 6)
    assert sorted((r.lo, r.hi) for r in spans.collect()) == [(at(-6), at(16)), (at(34), at(46)), (at(1494), at(1506))]
    holes = spark.createDataFrame([("a", at(1), at(3)), ("b", at(14), at(20))], "k string, lo_ timestamp_ntz, hi_ timestamp_ntz")
    assert {r.k: r.covered for r in sessions.inside(holes, spans, "lo_", "hi_").collect()} == {"a": True, "b": False}


def test_threshold_sweep_leaves_at_one_score(spark, monkeypatch):
    from types import SimpleNamespace

    from spreadloom.plans import surface

    rows = [("p", 1, at(i), float(i), z) for i, z in enumerate((2.5, 0.2, 0.2, 0.1))]
    z = spark.createDataFrame(rows, "pair string, sid int, t timestamp_ntz, s double, z double")
    monkeypatch.setattr(surface, "scored", lambda m: z)
    got = {r.threshold: (r.net, r.held) for r in surface.threshold_sweep(SimpleNamespace()).collect()}
    assert got == dict.fromkeys((1.0, 1.5, 2.0), (-1.0, 1))


def test_traders_and_draws_take_the_whole_job(spark):
    import inspect

    steps = spark.createDataFrame([("p", at(i), math.sin(i), math.cos(i * 1.7)) for i in range(650)], "pair string, t timestamp_ntz, x double, d double")
    assert inspect.signature(models.traders).parameters["epochs"].default == 60
    runs = models.train_traders(steps, "pair", "t", "d").collect()
    assert sorted(r.seed for r in runs) == list(range(20)) and {r.n for r in runs} == {650}
    size = inspect.signature(models.posterior).parameters
    assert (size["draws"].default, size["burn"].default) == (4000, 1000)


def walked(z, threshold):
    """(entry, exit, side) by walking the path."""
    out, pos, entry = [], 0, 0
    for i, v in enumerate(z):
        if pos:
            if abs(v) <= 0.5 or -pos * (v - z[entry]) >= 1:
                out.append((entry, i, pos))
                pos = 0
        elif abs(v) >= threshold:
            pos, entry = (-1 if v > 0 else 1), i
    return out + ([(entry, len(z), pos)] if pos else [])


def test_round_trips_equal_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(200):
        z = np.round(rng.normal(0, 1.3, rng.integers(1, 60)), 2)
        got = signals.round_trips(z, lambda i: True, np.flatnonzero(np.abs(z) >= 1.5))
        assert [tuple(x) for x in got.tolist()] == walked(z, 1.5)


def test_crossings_equal_a_walk(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(60):
        pos = 0
        for i in range(40):
            v = None if rng.random() < 0.1 else float(rng.choice([-2.5, -2, -1, -0.2, 0, 0.2, 1, 2, 2.5]))
            rows.append((k, i, v))
            if v is not None:
                if pos == 0:
                    pos = 0 if abs(v) < 2 else -1 if v > 0 else 1
                elif v * pos >= 0:
                    pos = 0
            want[k, i] = pos
    df = spark.createDataFrame(rows, "k int, t int, z double")
    assert {(r.k, r.t): r.pos for r in signals.held(df, ["k"], "t", "z", 2.0, 0.0, cross=True).collect()} == want


def test_refills_of_both_sides_by_hand(spark):
    def quote(second, bid, ask):
        return ("a", at(0, 0) + dt.timedelta(seconds=second), [(1.0, bid)], [(1.1, ask)])

    rows = [quote(0, 10.0, 8.0), quote(5, 4.0, 8.0), quote(20, 6.0, 2.0), quote(30, 11.0, 4.0), quote(40, 2.0, 7.0), quote(400, 1.0, 9.0), quote(410, 12.0, 9.0), quote(420, 6.0, None)]
    df = spark.createDataFrame(rows, "instr string, t timestamp_ntz, bids array<struct<px: double, qty: double>>, asks array<struct<px: double, qty: double>>")
    got = {(r.side, r.t, r.seconds) for r in book.refills(df, "instr").collect()}
    # the bid's second drop is settled too late, and the drop at that book belongs to it; the ask never is back in time
    assert got == {("bid", rows[1][1], 25.0)}
    # with more time the second drop and the ask are back
    longer = {(r.side, r.seconds) for r in book.refills(df, "instr", within=400).collect()}
    assert longer == {("bid", 25.0), ("bid", 370.0), ("ask", 380.0)}


def test_traders_learn_a_trend_and_pay_for_turning():
    rng = np.random.default_rng(3)
    r = np.repeat(rng.choice([-1.0, 1.0], 40), 12) + rng.normal(0, 0.2, 480)
    w = models.traders(r[:300], 3, lags=4, epochs=20)
    assert w.shape == (3, 6) and (models.profits(r[300:], w, 0.0) > 60).all()
    assert (models.profits(r[300:], w, 0.5) < models.profits(r[300:], w, 0.0)).all()


def test_walk_forward_rules(spark):
    rng = np.random.default_rng(4)
    x, rows = 0.0, []
    for i in range(400):
        new = 0.7 * x + rng.normal(0, 1)
        rows.append(("p", i, x, new - x))
        x = new
    got = {r.rule: r for r in models.walk_forward(spark.createDataFrame(rows, "pair string, t int, x double, d double"), "pair", "t", "x", "d", cost=0.1).collect()}
    assert set(got) == set(models.RULES) and got["z 1.5"].net > 0
    assert got["z 1.5 and probable"].entries <= got["z 1.5"].entries
