import datetime as dt
import json
import zlib

import pytest
from pyspark.sql import functions as F

from spreadloom.operators import bars as batch_bars
from spreadloom.plans import catalog
from spreadloom.plans.market import Market
from spreadloom.sources import feeds, files
from spreadloom.sources.store import KeyedStore
from spreadloom.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def drop(spark, tmp_path_factory):
    """Ticks of the small table in files that follow each other in time."""
    folder = tmp_path_factory.mktemp("ticks")
    ticks = Market(spark, SF).ticks.withColumn("totq", (F.col("event_id") * 7 % 1000).cast("double")).withColumn("t", F.col("t").cast("timestamp"))
    cuts = [r[0] for r in ticks.select(F.percentile(F.unix_micros("t"), F.array(*map(F.lit, (0.33, 0.66))))).first()]
    us = F.unix_micros("t")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 9e18], strict=True)):
        ticks.where((us >= a) & (us < b)).coalesce(1).write.mode("append").parquet(str(folder / f"p{k}"))
    flat = tmp_path_factory.mktemp("flat")
    for k in range(3):
        for f in (folder / f"p{k}").glob("*.parquet"):
            f.rename(flat / f"{k}-{f.name}")
    return str(flat), ticks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_streamed_bars_equal_batch_bars(spark, drop, tmp_path):
    folder, ticks = drop
    stream = live.bars(live.ticks_from(spark, folder, ticks.schema), "4 hours", "1 hour")
    live.run_available(stream, str(tmp_path / "c"), mode="complete", name="bars4")
    assert rows(spark.table("bars4")) == rows(batch_bars.tick_bars(ticks, "4 hours"))


def shuffled(spark, ticks, folder, columns, key):
    """Four files of rows, each up to 8 hours late, and a heartbeat; the frame of their schema."""
    rows = sorted(ticks.select(*columns).collect(), key=lambda r: (r.t.timestamp() + zlib.crc32(repr((r[key], r.t)).encode()) % (8 * 3600)))
    schema = ticks.select(*columns).schema
    size = len(rows) // 4 + 1
    beat = rows[0].asDict() | {key: "", "t": max(r.t for r in rows) + dt.timedelta(days=9)}
    for part in [*(rows[k : k + size] for k in range(0, len(rows), size)), [tuple(beat[c] for c in columns)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return schema


def test_streamed_counter_sizes_equal_batch(spark, drop, tmp_path):
    _, ticks = drop
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    schema = shuffled(spark, ticks, str(tmp_path / "in"), ["instr", "t", "px", "totq"], "instr")
    stream = live.counter_sizes(live.ticks_from(spark, str(tmp_path / "in"), schema), "9 hours")
    live.run_available(stream, str(tmp_path / "c"), mode="append", name="sizes")
    want = batch_bars.counter_sizes(ticks.drop("qty"), "totq").select("instr", "t", "px", "qty")
    assert rows(spark.table("sizes").where("instr <> ''")) == rows(want)


def test_late_ticks_and_rings_left_behind(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", at(0), 1.0), ("a", at(1), 3.0)], [("a", at(10), 2.0), ("b", at(9.5), 7.0)], [("a", at(9), 4.0), ("a", at(10.5), 6.0)], [("a", at(0.5), 99.0), ("", at(99), 0.0)], [("a", at(98.5), 5.0)], [("", at(200), 0.0)]]
    for part in batches:
        spark.createDataFrame(part, "key string, t timestamp, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.rolling_scores(live.ticks_from(spark, str(tmp_path / "in"), "key string, t timestamp, x double"), 2, 2, 120, "2 hours")
    live.run_available(stream, str(tmp_path / "c"), name="rings")
    got = sorted((r.key, r.t, r.r_n, r.r_mean, r.r_z) for r in spark.table("rings").where("key <> ''").collect())
    # 99.0 comes after the watermark has passed its time; a new session starts at 9 and at 98.5
    assert got == [("a", at(0), 1, None, None), ("a", at(1), 2, 2.0, 1.0), ("a", at(9), 1, None, None), ("a", at(10), 2, 3.0, -1.0), ("a", at(10.5), 2, 4.0, 1.0), ("a", at(98.5), 1, None, None), ("b", at(9.5), 1, None, None)]


def test_sessions_and_duplicates(spark, drop, tmp_path):
    folder, ticks = drop
    live.run_available(live.activity(live.ticks_from(spark, folder, ticks.schema), "8 hours", "1 hour"), str(tmp_path / "a"), mode="complete", name="acts")
    assert spark.table("acts").agg(F.sum("n")).first()[0] == ticks.count()
    live.run_available(live.once(live.ticks_from(spark, folder, ticks.schema, files=3), "40 days", ["event_id"]), str(tmp_path / "d"), mode="append", name="once_")
    assert spark.table("once_").count() == ticks.count()


def test_keyed_sink_is_idempotent(spark, drop, tmp_path):
    folder, ticks = drop
    sink, numbers = live.keyed_sink(str(tmp_path / "store"), ["instr"], largest=("px",)), []

    def last(batch, k):
        numbers.append(k)
        one = batch.groupBy("instr").agg(F.max("px").alias("px"))
        sink(one, k)
        sink(one, k)

    live.run_available(live.ticks_from(spark, folder, ticks.schema), str(tmp_path / "c"), each=last)
    store = KeyedStore(spark, str(tmp_path / "store"), ["instr"])
    assert rows(store.read()) == rows(ticks.groupBy("instr").agg(F.max("px")))
    assert store.versions() == [k + 1 for k in numbers]


def test_keyed_store_copies_what_it_touches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], 16, ("at",), keep=("first",), largest=("top",), guard=("note",))
    assert store.read() is None and store.manifest() is None
    schema = "k long, at int, last string, first string, top double, note string"
    one = spark.createDataFrame([(k, 0, "a", "a", 1.0, "n") for k in range(200)], schema)
    two = spark.createDataFrame([(5, 2, "c", "c", 0.5, ""), (5, 1, "b", "b", 7.0, "m"), (900, 1, "z", "z", None, "")], schema)
    assert store.write(one, 0) == 1 and store.write(one, 0) == 1
    before = store.read()
    files = store.manifest()["paths"]
    assert store.write(two, 1) == 2 and store.write(two, 1) == 2 and store.write(one, 0) == 2
    # two buckets at most were written anew, and whoever reads the old version still does
    assert sum(files.get(b) != p for b, p in store.manifest()["paths"].items()) <= 2
    assert before.count() == 200 and store.read(1).where("k = 5").first().last == "a"
    got = {r.k: tuple(r)[1:] for r in store.read().collect()}
    assert len(got) == 201 and got[5] == (2, "c", "a", 7.0, "m") and got[900] == (1, "z", "z", None, "")
    # a second writer has numbers of its own; a manifest that broke off counts for nothing; an empty batch is a version
    assert store.write(spark.createDataFrame([(5, 9, "w", "w", 1.0, "w")], schema), 0, writer="other") == 3
    (tmp_path / "s/manifest/000000000004").write_text('{"version": 4,')
    assert store.read().where("k = 5").first().last == "w"
    (tmp_path / "s/manifest/000000000004").unlink()
    assert store.write(one.where("false"), 2) == 4 and store.read().count() == 201
    store.vacuum(2)
    assert store.versions() == [3, 4] and store.read().count() == 201
    # where another writer made the version first, nothing is lost: the batch fails and can be written again
    told = store.manifest()
    with pytest.raises(Exception, match="exists"):
        store._commit(told)


def test_messages_split(spark):
    text = [json.dumps({"price": "1", "chetime": "090000"}), json.dumps({"bidho2": "3"}), json.dumps({"other": 1})]
    df = spark.createDataFrame([(t,) for t in text], "value string")
    trades, quotes = live.split_messages(df, "price string, chetime string, bidho2 string")
    assert trades.count() == 1 and quotes.count() == 1


def test_file_sources(spark, tmp_path):
    drop = [{"instr": "a", "date": "20240105", "time": "90100", "close": " 1.5 ", "volume": "x"}, {"instr": "a", "date": "20240105", "time": "90200", "close": "-1"}, {"instr": "a", "date": "bad", "time": "1", "close": "2"}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, drop)))
    got = files.bar_drop(spark, str(tmp_path / "d.json")).collect()
    assert len(got) == 1 and str(got[0].t) == "2024-01-05 09:01:00" and got[0].close == 1.5 and got[0].volume is None
    assert files.settings(spark, str(tmp_path / "none.json"), {"k": "1"}) == {"k": "1"}
    (tmp_path / "s.json").write_text('{"k": "2"}')
    assert files.settings(spark, str(tmp_path / "s.json"), {"k": "1", "j": "3"}) == {"k": "2", "j": "3"}
    log, day = str(tmp_path / "log"), spark.createDataFrame([("2024-01-01", 1)], "date string, n long")
    for _ in range(2):
        files.append_daily(spark, day, log, ["date"])
    assert spark.read.json(log).count() == 1
    pages = spark.createDataFrame([("a", k, [(k, 1.0), (k + 1, 2.0)], c) for k, c in enumerate(["x", "y", "y", "z"])], "instr string, page int, rows array<struct<t:int,close:double>>, cursor string")
    assert sorted(r.t for r in files.paged(pages).collect()) == [0, 1, 2, 3]
    files.wide_csv(spark.createDataFrame([(1, "p", 2.0), (1, "q", 3.0)], "t int, tag string, v double"), "t", "tag", "v", ["p", "q"], str(tmp_path / "wide"))
    assert spark.read.option("header", True).csv(str(tmp_path / "wide")).columns == ["t", "p", "q"]


def test_order_log_and_json_report(spark, tmp_path):
    one = spark.createDataFrame([("p", 1, "buy")], "pair string, leg int, side string")
    two = spark.createDataFrame([("p", 2, "sell")], "pair string, leg int, side string")
    for rows in (one, two):
        files.append_orders(rows, f"{tmp_path}/orders")
        files.json_report(rows, f"{tmp_path}/report")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/orders").collect())) == [("p", "1", "buy"), ("p", "2", "sell")]
    assert [r.side for r in spark.read.json(f"{tmp_path}/report").collect()] == ["sell"]


def test_late_tick_starts_no_bar_anew(spark, tmp_path):
    schema = "instr string, t timestamp, px double, qty double"

    def tick(k, minute, px):
        spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 9) + dt.timedelta(minutes=minute), px, 1.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    for k, (minute, px) in enumerate([(0, 1.0), (90, 2.0), (95, 3.0), (1, 99.0), (300, 4.0)]):
        tick(k, minute, px)
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        live.run_available(live.bars(source, "60 minutes", "10 minutes"), f"{tmp_path}/check", each=lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out"))
    got = sorted((r.t.hour, r.high, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(9, 1.0, 1), (10, 3.0, 2)]


def test_pages_are_pulled_until_a_cursor_ends_or_comes_again(spark, tmp_path):
    row = lambda h: {"t": f"2024-01-01T{h:02d}:00:00", "open": 1, "high": 2, "low": 0.5, "close": h, "volume": 3}
    pages = {"a": {"0": ([1], "x"), "x": ([2], "")}, "b": {"0": ([3], "y"), "y": ([4, 5], "0"), "z": None}, "c": {"0": ([], "q"), "q": ([6], "gone")}, "d": {"7": ([8], "7")}}
    for instr, own in pages.items():
        for cursor, page in own.items():
            where = tmp_path / f"instr={instr}" / f"cursor={cursor}"
            where.mkdir(parents=True)
            # a page that no cursor leads to is never looked at
            (where / "part-0").write_text(json.dumps({"rows": [row(h) for h in page[0]], "next": page[1]}) if page else "{broken")
    spark.dataSource.register(feeds.PagedBars)
    read = spark.read.format("paged_bars").option("path", str(tmp_path))
    df = read.load()
    assert sorted((r.instr, r.close) for r in df.collect()) == [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5), ("c", 6)]
    assert df.rdd.getNumPartitions() == 4
    assert [r.close for r in read.option("instruments", "d").option("first", "7").load().collect()] == [8]


def test_a_feed_is_split_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(feeds.Feed)
    stores = [KeyedStore(spark, str(tmp_path / n), ["id"], 4) for n in "tq"]
    broken = []

    def quotes(batch, number):
        if not broken:
            broken.append(number)
            raise RuntimeError("lost between the two sinks")
        stores[1].write(batch.select("id"), number)

    def run():
        stream = spark.readStream.format("feed").option("path", str(tmp_path / "in")).load()
        each = live.demultiplexed("id long, price double, chetime string, bidho2 double", lambda b, k: stores[0].write(b.select("id"), k), quotes)
        live.run_available(stream, str(tmp_path / "check"), each=each)

    def segment(k, ids):
        where = tmp_path / "in" / f"segment={k}"
        where.mkdir(parents=True)
        (where / "part-0").write_text("".join(json.dumps({"id": i} | ({"price": 1.0, "chetime": "090000"} if i % 2 else {"bidho2": 2.0})) + "\n" for i in ids))

    segment(0, range(4))
    segment(2, range(90, 94))
    with pytest.raises(Exception, match="lost between"):
        run()
    assert stores[0].read().count() == 2 and stores[1].read() is None
    run()
    # segment 2 waits for segment 1
    assert rows(stores[1].read()) == [(0,), (2,)]
    segment(1, range(50, 53))
    run()
    assert rows(stores[0].read()) == [(1,), (3,), (51,), (91,), (93,)] and stores[0].versions() == [1, 2]
    assert stores[1].read().count() == 6


@pytest.mark.parametrize("values", [(5.0, 5.0, 7.0, 0.5), (0.5,)])
def test_messages_of_one_time_all_land_once(spark, tmp_path, values):
    """Events of one type and time, two of them alike but for their number: each is a trade and a quote of its own. Few
    messages leave segments of the feed empty, and a lone event of 0.5 is no quote."""
    at = dt.datetime(2024, 1, 2, 9)
    events = [(k, at, 1, "click", value, '{"k": 3}') for k, value in enumerate(values)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, kinds).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["x7_demultiplexed"](spark, str(tmp_path)).select("kind", "instr", "t", F.round("px", 2))
    want = [("trade", "click", at, v) for v in values] + [("quote", "click", at, v - 0.02) for v in values if v > 1]
    assert rows(got) == sorted(want, key=str)


def test_a_place_in_the_feed_is_a_segment_and_a_line(spark, tmp_path):
    said = [b"{}", b"", '{"a": "one line, é"}'.encode(), b"x" * 50]
    where = tmp_path / "segment=0"
    where.mkdir()
    # the first file's last line ends with the file
    (where / "part-0").write_bytes(b"\n".join(said))
    (where / "part-1").write_bytes(b"last\n\n")
    for size in (1, 7, 50, 1 << 20):
        assert [v for block in feeds.lines_of(str(where), size) for v in block] == [*said, b"last", b""]
    spark.dataSource.register(feeds.Feed)
    stream = spark.readStream.format("feed").option("path", str(tmp_path)).load()
    live.run_available(stream, str(tmp_path / "check"), name="places")
    assert rows(spark.table("places")) == [(0, k, v.decode()) for k, v in enumerate([*said, b"last"]) if v]
