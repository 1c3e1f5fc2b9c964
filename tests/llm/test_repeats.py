import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import repeats


def slow(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text, from all its strings."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        n = int(gone.sum())
        out.append((len(t), n, int((np.diff(gone.astype(int)) == 1).sum()), bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)))
    return out


def slow_words(texts, words):
    """Words of each text in passages of `words` words that stand in two places."""
    own = [t.split() for t in texts]
    counts = Counter(tuple(t[i : i + words]) for t in own for i in range(len(t) - words + 1))
    out = []
    for t in own:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - words + 1):
            if counts[tuple(t[i : i + words])] > 1:
                gone[i : i + words] = True
        out.append(int(gone.sum()))
    return out


def corpus(rng, length):
    words = [f"w{i}x" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    passages = [text(rng.randint(length // 6, length // 2)) for _ in range(5)]
    out = [b"", b"short", text(400), b"ab" * length * 2, b"a" * (length + 3), "é".encode() * length]
    for _ in range(25):
        out.append(text(rng.randint(0, 80)) + b" " + rng.choice(passages) + b" " + text(rng.randint(0, 80)))
    base = text(200)
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = b"edit"
        out.append(b" ".join(w))
    return out + [out[2], base + b" " + base]


@pytest.mark.parametrize(("length", "crowd"), [(80, 20_000), (80, 2), (101, 20_000)])
def test_matches_brute_force(spark, length, crowd, monkeypatch):
    texts = corpus(random.Random(length + crowd), length)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    want = slow(texts, length)
    assert any(0 < w[1] < w[0] for w in want)
    got = {r.doc_id: r for r in repeats.strip_repeats(docs, length, 20, crowd, batches=3).collect()}
    said = slow_words(texts, 20)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == w, i
        assert r.kept_sha256 == hashlib.sha256(w[3]).hexdigest() and r.n_passage_words == said[i], i
    assert 0 < sum(0 < x < len(t.split()) for x, t in zip(said, texts, strict=True))


def test_anchors_of_pieces_and_of_the_whole_agree(monkeypatch):
    a = np.frombuffer(random.Random(3).randbytes(30_000), np.uint8)
    want = repeats.anchors(a)
    monkeypatch.setattr(repeats, "STRIDE", 1000)
    got = repeats.anchors(a)
    pair = lambda x: [(p, s) for p, lo, hi in zip(*x, strict=True) for s in range(lo, hi + 1)]
    assert pair(got) == pair(want)


def test_family_finds_equals_across_levels_and_merges_them(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 60, 70).tolist()
    family, hits, sizes = repeats.Family(), set(), []
    for k in range(0, 70, 10):
        hits |= {r.key for r in family.add(spark.createDataFrame([(x,) for x in keys[k : k + 10]], "key long")).collect()}
        sizes.append([n for n, _ in family.levels])
    assert hits == {k for k, n in Counter(keys).items() if n > 1}
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    assert sum(r.n for _, level in family.levels for r in level.collect()) == 70
    family.close()


def test_edge_cases(spark):
    long = "words of a very long text " * 4000
    rows = [(1, None), (2, ""), (None, long), (None, long), (5, "x" * 399), (6, "x" * 400), (7, "y" * 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("data", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.strip_repeats(docs, with_text=False).collect()), key=str)
    n = len(long)
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (None, n, n, 1), (None, n, n, 1), (5, 399, 0, 0), (6, 400, 0, 0), (7, 401, 401, 1)], key=str)
    assert repeats.strip_repeats(docs.where("false")).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = slow([(r.text or "").encode() for r in rows], 400)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.op10_repeats(spark, sf).collect()}
    assert got == {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, want, strict=True)}
