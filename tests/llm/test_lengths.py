from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadloom.llm import lengths, packing

KEYS = ("length", "docs", "tokens", "docs_over", "tokens_over", "docs_at_most", "tokens_at_most", "truncated_tokens")


def slow(ns):
    out = []
    for x, n in sorted(Counter(ns).items()):
        over = [y for y in ns if y > x]
        out.append((x, n, n * x, len(over), sum(over), len(ns) - len(over), sum(ns) - sum(over), sum(min(y, x) for y in ns)))
    return out


def test_histogram_limits_and_quantiles(spark):
    ns = [0, 0, 3, 3, 3, 511, 512, 513, 5000, 5000, 70_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "doc_id long, length long")
    hist = lengths.histogram(df)
    assert sorted(tuple(r[k] for k in KEYS) for r in hist.collect()) == slow(ns)
    limits = [0, 1, 3, 512, 4999, 10**6]
    got = {r.limit: (r.docs_over, r.truncated_tokens) for r in lengths.at_limits(hist, limits).collect()}
    assert got == {x: (sum(n > x for n in ns), sum(min(n, x) for n in ns)) for x in limits}
    got = {r.share: r.length for r in lengths.quantiles(hist, [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 0, 0.5: 511, 1.0: 70_000}
    no = lengths.histogram(df.where("false"))
    assert no.count() == 0 and lengths.at_limits(no, [5]).first().truncated_tokens == 0


def test_query_matches_plain_counts_and_nulls_count_as_empty(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(packing.word_tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow([len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()])
    assert sorted(tuple(r[k] for k in KEYS) for r in lengths.op2_lengths(spark, sf).collect()) == want
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a b")], "doc_id long, text string").withColumn("length", F.lit("clash"))
    assert sorted(r.length for r in lengths.encoded_lengths(odd, packing.word_tokenizer()).collect()) == [0, 0, 2]


def test_long_texts_repeats_and_clashing_columns(spark):
    long = "word, " * 300_000
    rows = [(1, long), (2, "a b"), (2, "a b"), (None, "a b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(9).alias("docs"), F.lit(9).alias("block"), F.lit(9).alias("tokens"))
    found = lengths.encoded_lengths(docs, packing.word_tokenizer())
    assert sorted(r.length for r in found.collect()) == [0, 2, 2, 2, 600_000]
    hist = lengths.histogram(found.select("*", F.lit(9).alias("docs"), F.lit(9).alias("block"), F.lit(9).alias("tokens")))
    assert sorted(tuple(r[k] for k in KEYS) for r in hist.collect()) == slow([0, 2, 2, 2, 600_000])
