import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spreadloom.llm import lines
from spreadloom.llm.common import shared_folder


def slow(docs, threshold):
    """Removed places per doc, by comparing every line with every earlier one."""
    seen, out = [], {}
    for d, text in sorted(docs.items()):
        out[d] = []
        for no, line in enumerate((text or "").split("\n")):
            s = frozenset(line.lower().split())
            if s and any(len(s & e) + 1e-9 >= threshold * len(s | e) for e in seen):
                out[d].append(no)
            seen.append(s)
    return out


@pytest.mark.parametrize(("threshold", "crowd"), [(0.8, 64), (0.8, 2), (0.65, 3)])
def test_matches_brute_force(spark, threshold, crowd):
    rng = random.Random(crowd)
    common, rare = ["the", "of", "And", "in"], [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(common + rare) for _ in range(rng.randint(1, 25))) for _ in range(25)]

    def edited(line):
        w = line.split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice(rare)]
        rng.shuffle(w)
        return "  ".join(w)

    docs = {d: "\n".join(rng.choice(["", " ", edited(rng.choice(base)), rng.choice(base), "the of", "the of and"]) for _ in range(rng.randint(0, 8))) for d in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in lines.line_removals(df, threshold, crowd).collect()}
    assert got == slow(docs, threshold)


def test_edge_cases(spark):
    rows = [(None, "alpha beta"), (2, None), (3, ""), (1, "alpha BETA\n\nx"), (4, "beta\talpha alpha"), (5, "once only"), (5, "once only"), (None, "once only\nnew"), (6, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_lines, list(r.removed)) for r in lines.line_removals(docs).collect()), key=str)
    want = [(None, 1, [0]), (2, 1, []), (3, 1, []), (1, 3, []), (4, 1, [0]), (5, 1, []), (5, 1, [0]), (None, 2, [0]), (6, 1, [])]
    assert got == sorted(want, key=str)
    assert lines.line_removals(docs.where("false")).count() == 0
    kept = docs.where("doc_id = 1").select(lines.without_lines(F.col("text"), F.array(F.lit(1))).alias("t")).first().t
    assert kept == "alpha BETA\nx"


def test_many_unlike_lines_on_two_common_words(spark):
    rng = random.Random(9)
    text = {d: "\n".join("aa bb " + " ".join(f"w{rng.randrange(900)}" for _ in range(4)) for _ in range(100)) for d in range(100)}
    text[200] = text[7].split("\n")[3] + "\n" + "zz yy xx"
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in lines.line_removals(docs).collect()}
    seen, want = {}, {}
    for d, t in text.items():
        want[d] = []
        for no, line in enumerate(t.split("\n")):
            s = frozenset(line.split())
            near = {e for w in s - {"aa", "bb"} for e in seen.get(w, ())}
            if any(len(s & e) + 1e-9 >= 0.8 * len(s | e) for e in near):
                want[d].append(no)
            for w in s - {"aa", "bb"}:
                seen.setdefault(w, set()).add(s)
    assert got == want and 0 in got[200]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(lines.OP5_SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in lines.op5_lines(spark, sf).collect())
    assert got == want and sum(w[2] for w in want) > 20


def test_disk_in_use_stays_below_the_words_of_all_lines(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(d, "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20))) for d in range(300)], "doc_id long, text string")
    folder, used, whole = Path(shared_folder(spark).removeprefix("file:")), [], lines.save

    def stored():
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def save(*a):
        out = whole(*a)
        used.append(stored())
        return out

    before = stored()
    monkeypatch.setattr(lines, "save", save)
    assert lines.line_removals(docs).count() == 300
    # a word's hash is 8 bytes
    assert max(used) - before < 300 * 20 * 50 * 8


def stored_at_most(docs, monkeypatch, **kwargs):
    """The removals, and the most bytes that stand in the shared folder meanwhile."""
    folder, used, whole = Path(shared_folder(docs.sparkSession).removeprefix("file:")), [], lines.save
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = stored()
    monkeypatch.setattr(lines, "save", lambda *a: (whole(*a), used.append(stored()))[0])
    got = {r.doc_id: list(r.removed) for r in lines.line_removals(docs, **kwargs).collect()}
    return got, max(used) - before


def test_lines_of_few_words_are_not_multiplied(spark, monkeypatch):
    # every word is in some 300 lines, so each is crowded; hardly two lines are alike
    rng = random.Random(4)
    text = {d: "\n".join(" ".join(f"w{rng.randrange(600)}" for _ in range(30)) for _ in range(20)) for d in range(300)}
    text[300] = "\n".join(" ".join(text[d].split("\n")[0].split()[:-1] + ["new"]) for d in range(5))
    got, most = stored_at_most(spark.createDataFrame(list(text.items()), "doc_id long, text string"), monkeypatch, crowd=16)
    assert got == {d: [0, 1, 2, 3, 4] if d == 300 else [] for d in text}
    # 8 bytes a word, of every line
    assert most < 300 * 20 * 30 * 8


@pytest.mark.parametrize("threshold", [0.4, 0.51, 0.7, 0.8, 0.9, 1.0])
def test_similar_sets_share_a_key(spark, threshold):
    rng = random.Random(7)
    sets = []
    for _ in range(150):
        one = {rng.randrange(1 << 20) for _ in range(rng.randint(1, 30))}
        sets += [one, {w for w in one if rng.random() > 0.12} | {rng.randrange(1 << 20) for _ in range(rng.randint(0, 4))}]
    sets = {k: s for k, s in enumerate(sets) if s}
    # so that words differ after the bits that keys leave out
    rows = [(k, sorted(w << lines.SHORT for w in s)) for k, s in sets.items()]
    df = spark.createDataFrame(rows, "k1 long, words array<bigint>").select("k1", F.size("words").cast("long").alias("n"), lines.parities(F.col("words")).alias("bits"), lines.prefix(F.col("words"), threshold).alias("rarest"))
    keys = {}
    for share in range(lines.SHARES):
        for r in lines.shared_keys(df, threshold, share).collect():
            keys.setdefault(r.k1, set()).add(r.key)
    alike = [(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) + 1e-9 >= threshold * len(sets[x] | sets[y])]
    assert alike or threshold == 1.0
    assert all(keys.get(x, set()) & keys.get(y, set()) for x, y in alike)
