import numpy as np
from pyspark.sql import functions as F

from spreadloom.llm import quality


def test_statistics_of_known_texts():
    got = dict(zip(quality.STATS, quality.statistics(b"Aa aa Aa.\nAa aa Aa."), strict=True))
    assert got["distinct_words"] == 3 / 6 and got["distinct_lines"] == 0.5 and got["stops_per_word"] == 2 / 6 and got["upper_share"] == 4 / 12
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.STATS)


def test_ensemble_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(quality.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    m = quality.fit(x[:1000], y[:1000])
    assert ((m.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert 0 < len(m.rules) < 150
    assert quality.fit(x[:0], y[:0]).rules == [] and quality.fit(x[:5], np.ones(5)).bias > 0


def test_column_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.STATS)))
    m = quality.fit(x, (x[:, 0] > x[:, 1]).astype(float))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "stats array<double>")
    got = [r[0] for r in df.select(m.column(F.col("stats"))).collect()]
    assert np.allclose(got, m.score(x))


def test_held_out_accuracy_and_edge_cases(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op7_rules(spark, sf).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == quality.is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-2, ""), (-3, "long " * 200_000)], "doc_id long, text string")
    mixed = docs.unionByName(odd, allowMissingColumns=True).withColumn("stats", F.lit("clash"))
    rows = quality.scored(mixed, labels.unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"), allowMissingColumns=True)).collect()
    assert len(rows) == docs.count() + 5 and all(r.score is not None for r in rows)
    kept = quality.keep_good(spark, mixed, labels)
    assert kept.columns == mixed.columns and 0 < kept.count() < mixed.count()
    assert quality.scored(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.where("false")).collect()} == {0.5}
