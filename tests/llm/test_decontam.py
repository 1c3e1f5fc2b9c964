import random

from pyspark.sql import functions as F

from spreadloom.llm import decontam


def slow(item, text):
    """Least edit distance of item to a stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abc ") + text[at:], text[:at] + rng.choice("xyz") + text[at + 1 :]])
    return text


def test_myers_matches_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
        assert decontam.myers(item, text)[0] == slow(item, text)


def test_search_finds_exactly_what_lies_within_the_budget():
    rng = random.Random(2)
    words = ["and", "of", "the", "erin", "thble", "onst"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(2, 30)))) for k in range(15)]
    s = decontam.Searcher(items, 0.08)
    for _ in range(60):
        k, item = rng.choice(items)
        text = decontam.normal(" ".join(rng.choice(words) for _ in range(15)) + " " + edited(rng, item, rng.randint(0, 8)) + " " + " ".join(rng.choice(words) for _ in range(15)))
        got = {i: d for i, d, _ in s.find(text)}
        want = {i: d for i, t in items if (d := slow(f" {t} ", f" {text} ")) <= int(len(t) * 0.08)}
        assert got == want


def test_items_are_whole_words():
    s = decontam.Searcher([(1, "art"), (2, "the start of it all in one line")], 0.08)
    assert s.find("we start here") == [] and s.find("art") == [(1, 0, 3)] and s.find("modern art is") == [(1, 0, 10)]
    assert s.find("see the start of it all in one line") == [(2, 0, 35)]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.op8_decontaminate(spark, sf).collect()}
    short = [r for r in docs if len(r.text or "") < 4000][:60]
    for item in bench:
        t = f" {decontam.normal(item.text)} "
        for d in short:
            text = f" {decontam.normal(d.text)} "
            best = decontam.myers(t, text)[0]
            assert got.get((d.doc_id, item.item_id)) == (best if best <= int((len(t) - 2) * decontam.RATE) else None)


def test_edge_cases(spark):
    item = "Exactly this sentence, word for word, is in the test."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "?!"), (None, "dropped item"), (5, item.upper()), (5, "another text for the same item id")], "item_id long, text string")
    rows = [(1, f"x {item} y"), (2, None), (3, ""), (None, item.replace("word", "wurd", 1)), (4, "clean"), (4, f"{item} {item}"), (5, "long " * 100_000 + item), (6, "an ANOTHER text, for the same item-id!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("distance", F.lit("clash"))
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontam.hits(docs, bench).collect()), key=str)
    want = [(d, i, e) for d, e in ((1, 0), (None, 1), (4, 0), (5, 0)) for i in (1, 5)] + [(6, 5, 0)]
    assert got == sorted(want, key=str)
    kept = decontam.keep_clean(spark, docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4"]
    assert decontam.hits(docs.where("false"), bench).count() == 0 and decontam.hits(docs, bench.where("false")).count() == 0
    assert decontam.keep_clean(spark, docs, bench.where("false")).count() == len(rows)


def test_blocks_of_items_give_the_same_hits(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, decontam.op8_decontaminate(spark, sf).collect()))
    assert want
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(list(decontam.blocks_of(bench, 900))) > 1
    assert sorted(map(tuple, decontam.hits(docs, bench, block_size=900).collect())) == want
    clean = decontam.keep_clean(spark, docs, bench, block_size=900)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {w[0] for w in want}


def test_long_texts_ties_and_clashing_columns(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"
    filler = "nothing to see here at all " * 80_000
    near = item.replace("quick", "quack")
    rows = [(1, filler + item + " " + filler), (2, near + " zzz " + near + " " + filler), (2, "short"), (3, filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("item_id"), F.lit("x").alias("distance"), F.lit("x").alias("ends_at"))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn("doc_id", F.lit("y"))
    got = sorted((r.doc_id, r.item_id, r.distance, r.ends_at) for r in decontam.hits(docs, bench).collect())
    # of two places as near as each other the first counts; the other text of one id is a row of its own
    assert got == [(1, 7, 0, len(filler) + len(item)), (2, 7, 1, len(item))]
    assert sorted(r.text[:5] for r in decontam.keep_clean(spark, docs, bench).collect()) == ["nothi", "short"]
    assert decontam.keep_clean(spark, docs, bench).columns == docs.columns
