import glob
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from spreadloom.llm import phrases

SF = "/root/testdata/sf0.01"


def slow(rows, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            own = f.setdefault(lang, Counter())
            for k in (1, 2, 3):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in cands.items()):
                continue
            s, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = [*"abcdefg", "A", "É", "ß", "x\x01", "x", "\x1f", " ", " ", "日本"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "; "]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [None, "", " \t", "...", "New York City " * 40, "New York " * 30]
    return [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", texts[0])] * 3


@pytest.mark.parametrize(("chunk", "entries", "burst", "limit"), [(2 << 20, 600_000, 4096, 400_000), (64, 50, 3, 400_000), (64, 10**6, 3, 5)])
def test_brute_force(spark, monkeypatch, chunk, entries, burst, limit):
    for name, v in (("CHUNK", chunk), ("ENTRIES", entries), ("BURST", burst), ("WORDS", limit)):
        monkeypatch.setattr(phrases, name, v)
    rows = corpus(chunk + burst)
    batch = [__import__("pyarrow").RecordBatch.from_pydict({"lang": ["und" if a is None else a for a, _ in rows], "text": [t or "" for _, t in rows]})]
    # runs of small tries in this process, merged: the same counts as plain ones
    runs = sorted(phrases.task_runs(iter(batch), 7), key=lambda r: r[:2])
    got = Counter()
    for lang, _, phrase, n in phrases.task_merges(phrases.batches_of(iter(runs), phrases.RUNS, 5), 1):
        got[lang, phrase] += n
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            for k in (1, 2, 3):
                want.update((lang, " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
            want[lang, ""] += len(ws)
    assert got == +want
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs, 3, parts=5)) == slow(rows, 3)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(9), "lang string, text string")
    clash = docs.selectExpr("lang", "text", "1 as phrase", "2 as n", "3 as words", "4 as part", "5 as total")
    assert rows_of(phrases.collocations(clash)) == slow(corpus(9))
    assert phrases.collocations(docs.where("false")).collect() == []
    long = [("en", "the cat sat " * 600_000), ("en", "x" * 3_000_000 + " cat sat")]
    got = rows_of(phrases.collocations(spark.createDataFrame(long, "lang string, text string")))
    # 7 MB in one text, in parts: no phrase is lost or counted twice where it is cut
    assert {r[2]: r[3] for r in got} == {"the cat sat": 600_000, "cat sat the": 599_999, "sat the cat": 599_999}
    tied = [("en", "b c. a b. d e. ") for _ in range(12)]
    assert rows_of(phrases.collocations(spark.createDataFrame(tied, "lang string, text string"))) == slow(tied)


def test_scores_are_exact(spark):
    rows = [(10**13 + 7, 10**13 + 9, 10**14 - 1), (3, 3, 3), (99_999_999_999_999, 10**15, 10**16 + 1)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_query_and_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    got = phrases.op13_phrases(spark, SF)
    want = c.sql(phrases.OP13_SQL)
    assert got.columns == want.columns
    assert rows_of(got) == sorted(want.fetchall())
