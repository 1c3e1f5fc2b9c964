"""Scans by blocks give what one window over a whole series gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spreadloom.operators import book, scans, sessions, signals, stats


def rows_of(df, *names):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in names or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = []
    for key in "abc":
        t = dt.datetime(2024, 1, 1)
        for _ in range({"a": 400, "b": 150, "c": 1}[key]):
            t += dt.timedelta(minutes=rng.choice([1, 5, 30, 70, 200, 3000]))
            rows.append((key, t, rng.choice([None, rng.gauss(0, 1.2), rng.gauss(0, 1.2)]), float(rng.randrange(-5, 6))))
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, z double, x double").cache()


@pytest.mark.parametrize("minutes", [60, 720, 1440, 1440 * 7])
def test_scans_equal_windows(series, minutes):
    key = ["k"]
    assert rows_of(scans.sessionize(series, key, "t", 60, minutes=minutes)) == rows_of(sessions.sessionize(series, key, "t", 60))
    assert rows_of(scans.drawdown(series, key, "t", "x", minutes), "k", "t", "total", "peak", "drawdown") == rows_of(stats.drawdown(series, key, "t", "x"), "k", "t", "total", "peak", "drawdown")
    for enter, leave in ((2.0, 0.25), (1.0, 0.9), (0.5, 0.0)):
        assert rows_of(scans.held(series, key, "t", "z", enter, leave, minutes)) == rows_of(signals.held(series, key, "t", "z", enter, leave))
    numbers = {(r.k, r.n) for r in scans.numbered(series, key, "t", "n", minutes).collect()}
    assert numbers == {(k, n) for k, c in (("a", 400), ("b", 150), ("c", 1)) for n in range(c)}


@pytest.mark.parametrize("minutes", [60, 1440])
@pytest.mark.parametrize(("forward", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_as_of_over_blocks(spark, series, minutes, forward, strict):
    rng = random.Random(6)
    left = [(r.k, r.t, i) for i, r in enumerate(series.collect())]
    span = sorted({t for _, t, _ in left})
    right = [(k, rng.choice(span) if rng.random() < 0.5 else rng.choice(span) + dt.timedelta(minutes=3)) for k in "abd" for _ in range(25)]
    right = [(k, t, float(i)) for i, (k, t) in enumerate(sorted(set(right)))]
    for keys in (["k"], []):
        rates = right if keys else [(k, t, v) for k, t, v in right if k == "a"]
        df = spark.createDataFrame(rates, "k string, t timestamp_ntz, rate double")
        got = scans.carried(spark.createDataFrame(left, "k string, t timestamp_ntz, i int"), df if keys else df.drop("k"), keys, "rate", forward, strict, minutes)
        want = []
        for k, t, i in left:
            ok = [(u, v) for q, u, v in rates if (q == k or not keys) and ((u > t or (u == t and not strict)) if forward else (u < t or (u == t and not strict)))]
            best = (min(ok) if forward else max(ok)) if ok else (None, None)
            want.append((k, t, i, best[1], best[0]))
        assert rows_of(got, "k", "t", "i", "rate", "rate_t") == sorted(want, key=repr)


def test_no_task_holds_a_whole_series(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp_ntz")
        df = spark.range(40_000).select(F.lit("one").alias("k"), t.alias("t"), (F.col("id") % 7 - 3).cast("double").alias("x"))
        out = scans.drawdown(scans.sessionize(df, ["k"], "t", 60), ["k"], "t", "x")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        # one series, 278 days: dealt over all partitions
        assert len(sizes) >= 4 and max(sizes) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_long_frames_of_quartiles(spark, series):
    rows = series.withColumn("x", F.when(F.col("z").isNotNull() | (F.col("x") > 3), F.col("x")))
    got = scans.rolling_quartiles(rows, ["k"], "t", "x", 13)
    assert rows_of(got, "k", "t", "x", "r_med", "r_iqr") == rows_of(stats.rolling_quartiles(rows, ["k"], "t", "x", 13), "k", "t", "x", "r_med", "r_iqr")
    # six months by the minute
    n, frame = 60_000, 49_140
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp_ntz")
    long = spark.range(n).select(F.lit("one").alias("k"), F.col("id"), t.alias("t"), F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double").alias("x"))
    values = [r.x for r in long.orderBy("id").collect()]
    got = {r.id: (r.r_med, r.r_iqr) for r in scans.rolling_quartiles(long, ["k"], "t", "x", frame).where("id % 3000 = 1 or id = 49140 or id = 49139").collect()}
    for i, found in got.items():
        v = sorted(values[i - frame : i]) if i >= frame else None
        assert found == ((v[frame // 2], v[3 * frame // 4] - v[frame // 4]) if v else (None, None))
    assert len(got) == 22


def test_forward_join_goes_through_a_crowded_block_once(spark):
    """A frame that runs on to its end is summed up anew for each row: work grew with the square of a block."""
    n = 40_000
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("t")
    left = spark.range(n).select(F.lit("a").alias("k"), at, "id")
    right = spark.range(0, n, 2).select(F.lit("a").alias("k"), at, F.col("id").alias("v"))
    got = scans.carried(left, right, ["k"], "v", forward=True)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert got.where(F.col("v") == F.col("id") + F.col("id") % 2).count() == n - 1 and got.where("v is null").count() == 1


def test_book_before_by_blocks_with_books_of_one_time(spark):
    """The book before is found over blocks of time, in one order whatever order books come in."""
    rng, kind = random.Random(8), "k string, t timestamp_ntz, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>"
    start, rows = dt.datetime(2024, 1, 1, 20), []
    for k in ("a", None):
        for _ in range(120):
            t = start + dt.timedelta(hours=rng.randrange(0, 200, 8))
            px = rng.choice([None, 5.0, 6.0, 7.0, 8.0])
            level = lambda up: [(px and px + up * i, float(rng.randrange(9))) for i in range(1, 6)]
            rows.append((k, t, level(-0.1), level(0.1)))
    got = [rows_of(book.features(spark.createDataFrame(part, kind).repartition(3), ["k"]), "k", "t", "mid", "voi") for part in (rows, rows[::-1])]
    assert got[0] == got[1]
    want = []
    for k in ("a", None):
        low = lambda r: (r[1], *[[(px is not None, px or 0.0, q) for px, q in side] for side in r[2:]])
        own = sorted((r for r in rows if r[0] == k), key=low)
        for old, now in zip([None, *own], own, strict=False):
            if now[2][0][0] is None:
                continue
            voi = None
            if old and old[2][0][0] is not None:
                gain = lambda s, better: (now[s][0][1] if better * (now[s][0][0] - old[s][0][0]) > 0 else 0.0 if now[s][0][0] != old[s][0][0] else now[s][0][1] - old[s][0][1])
                voi = gain(2, 1) - gain(3, -1)
            want.append((k, now[1], round((now[2][0][0] + now[3][0][0]) / 2, 9), voi))
    assert got[0] == sorted(want, key=repr)
