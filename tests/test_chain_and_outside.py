import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom import __main__ as cli
from spreadloom.functions import calendar
from spreadloom.functions import columns as c
from spreadloom.operators import bootstrap
from spreadloom.plans.chain import Chain
from spreadloom.plans.market import Market
from spreadloom.sources import files

SF = "/root/testdata/sf0.001"


def test_contracts_equal_the_column_functions(spark):
    spark.udtf.register("contracts", calendar.Contracts)
    spark.createDataFrame([("ZN", dt.date(1999, 12, 15), dt.date(2031, 6, 2)), ("65", dt.date(2019, 1, 1), dt.date(2019, 12, 31)), (None, dt.date(2020, 1, 1), dt.date(2021, 1, 1)), ("ZF", dt.date(2020, 4, 1), dt.date(2020, 5, 1))], "root string, a date, b date").createOrReplaceTempView("asked")
    got = spark.sql("select root, c.* from asked, lateral contracts(root, a, b) c")
    month = F.col("month")
    want = got.select("root", F.when(F.col("root") == "65", c.krx_code(F.lit("65"), month)).otherwise(c.us_code(F.col("root"), month)), "month", c.third_tuesday(month), c.last_weekday(month), c.first_notice(month), c.last_trading(month))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect()))
    # the month of the first date counts if it begins on or after it
    assert [r[2] for r in rows if r[0] == "65"] == [dt.date(2019, m, 1) for m in (3, 6, 9, 12)] and not [r for r in rows if r[0] == "ZF"]
    assert min(r[2] for r in rows if r[0] == "ZN") == dt.date(2000, 3, 1) and max(r[2] for r in rows if r[0] == "ZN") == dt.date(2031, 6, 1)


def test_block_bootstrap_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    data = {"a": 50, "b": 7, "c": 8}
    rows = [(k, i, float(x), float(y)) for k, n in data.items() for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    got = {(r.k, r.seed): r.slope for r in bootstrap.slopes(df, ["k"], "t", "x", "y", 8, 30).collect()}
    want = {}
    for k, n in data.items():
        if n < 8:
            continue
        xy = np.array([r[2:] for r in rows if r[0] == k])
        for seed in range(1, 31):
            starts = [((seed * 7919 + j * 104729 + 1) * 2654435761 % 4294967296) % (n - 7) for j in range(-(-n // 8))]
            s = np.concatenate([xy[i : i + 8] for i in starts])
            want[k, seed] = np.polyfit(s[:, 0], s[:, 1], 1)[0]
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)
    # replicates differ, and their starts reach all of a series
    assert len({round(v, 9) for q, v in got.items() if q[0] == "a"}) > 25


@pytest.mark.parametrize("stage", ["collect", "health", "backfill"])
def test_the_chain_goes_on_where_it_broke_off(spark, tmp_path, stage):
    m = Market(spark, SF)
    days = sorted(r[0] for r in m.bars.select(F.to_date("t").alias("day")).distinct().orderBy(F.desc("day")).limit(2).collect())
    broken, whole = Chain(m, str(tmp_path / "a"), 3), Chain(m, str(tmp_path / "b"), 3)
    first = broken.run(days[0], stop_after=stage)
    assert first + broken.run(days[0]) == list(Chain.STAGES) and broken.run(days[0]) == []
    assert whole.run(days[0]) == list(Chain.STAGES)
    told = lambda ch: sorted(map(tuple, ch.report().collect()), key=repr)
    assert told(broken) == told(whole) and told(whole)
    before = broken.store("econ").read().count()
    assert broken.run(days[1]) == list(Chain.STAGES) and broken.run(days[1]) == []
    assert broken.store("econ").read().count() > before
    bars = broken.store("collect").read()
    want = m.bars.where(F.to_date("t").isin(days)).select("instr", "t", "close")
    assert bars.count() == want.count() and bars.exceptAll(want).count() == 0


def test_one_way_in(spark, tmp_path, capsys):
    assert "g14_pair_report" in cli.main(["names"])
    out = cli.main(["status", "--tables", SF])
    assert out[0].split("\t") == ["instr", "n", "last_t", "last", "age"] and len(out) == 6
    assert len(cli.main(["query", "x_spread_view", "--tables", SF, "--rows", "3"])) == 4
    day = Market(spark, SF).bars.agg(F.max(F.to_date("t"))).first()[0].isoformat()
    assert cli.main(["daily", day, "--tables", SF, "--store", str(tmp_path)])[0] == "ran " + ", ".join(Chain.STAGES)
    assert cli.main(["daily", day, "--tables", SF, "--store", str(tmp_path)])[0] == "ran nothing: the day is done"
    for wrong in (["query", "nothing"], ["daily"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


def test_closing_records_are_logged_once_and_not_before_three(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 2, h)
    log = str(tmp_path / "log")
    early = spark.createDataFrame([("a", "d1", at(14), 1.0)], "k string, day string, asof timestamp_ntz, v double")
    files.append_daily(spark, early, log, ["k", "day"], "asof")
    late = spark.createDataFrame([("a", "d1", at(14), 1.0), ("a", "d1", at(16), 3.0), ("a", "d1", at(15), 2.0), ("b", "d1", at(23), 9.0)], early.schema)
    for rows in (late, late.where("v > 2")):
        files.append_daily(spark, rows, log, ["k", "day"], "asof")
    assert sorted((r.k, r.v) for r in spark.read.json(log).collect()) == [("a", 2.0), ("b", 9.0)]
