import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from spreadloom.llm import exactdedup


def test_cuts_depend_on_content_and_cover_the_text():
    rng = random.Random(5)
    body = rng.randbytes(200_000)
    text, chunks = exactdedup.chunked(body)
    assert b"".join(chunks) == text == bytes(c + 32 if 65 <= c <= 90 else c for c in body)
    assert max(map(len, chunks)) <= exactdedup.LONGEST
    shifted = exactdedup.chunked(b"x" * 777 + body)[1]
    assert len(set(chunks) & set(shifted)) > 0.9 * len(set(chunks))
    assert exactdedup.chunked(None) == (b"", [])
    flat = exactdedup.chunked(b"a" * 100_000)[1]
    assert b"".join(flat) == b"a" * 100_000 and max(map(len, flat)) <= exactdedup.LONGEST


def test_stride_does_not_move_cuts(monkeypatch):
    body = random.Random(6).randbytes(50_000)
    want = exactdedup.chunked(body)[1]
    monkeypatch.setattr(exactdedup, "STRIDE", 777)
    assert exactdedup.chunked(body)[1] == want


ROWS = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, "x"), (6, "x"), (None, "x"), (None, "alone"), (None, "alone"), (7, "y"), (7, "z")]


def test_groups_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("recipe", F.lit(1))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.duplicate_groups(docs).collect()]
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 3, True), (6, 6, 3, False), (None, 6, 3, False),
            (None, None, 2, True), (None, None, 2, False), (7, 7, 1, True), (7, 7, 1, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = exactdedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", "aBC É"), ("3", "abc é"), ("5", ""), ("6", "x"), ("None", "alone"), ("7", "y"), ("7", "z")])
    assert exactdedup.duplicate_groups(docs.where("false")).count() == 0
    assert exactdedup.keep_one(spark, docs.where("false")).count() == 0


def test_weak_identifiers_are_replaced(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id long, text string")
    weak = lambda c: hashlib.md5(c).digest()[:1] if len(c) % 2 else b"\0"
    got = exactdedup.duplicate_groups(docs, (weak, exactdedup.long_id)).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id | 1 and r.kept == (r.doc_id % 2 == 1) for r in got)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(exactdedup.OP3_SQL).fetchall())
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.op3_exact_dedup(spark, sf).collect())
    assert got == want


def test_very_long_texts(spark):
    long = "Some words of a long text. " * 80_000
    docs = spark.createDataFrame([(1, long), (2, long.upper()), (3, long + "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exactdedup.duplicate_groups(docs).collect())
    assert got == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
