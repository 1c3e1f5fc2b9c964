import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spreadloom.llm import simhash
from spreadloom.llm.common import save


def slow_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def slow_groups(fps):
    """fps: {doc_id: fp}; component ids by a plain search."""
    left, out = set(fps), {}
    while left:
        todo = [min(left)]
        group = set()
        while todo:
            d = todo.pop()
            if d in group:
                continue
            group.add(d)
            todo += [e for e in left if e not in group and (fps[d] ^ fps[e]).bit_count() <= 2]
        out |= dict.fromkeys(group, min(group))
        left -= group
    return out


def test_fingerprint_matches_plain_count():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " ".join(rng.choice(["Ab", "cé", "x\ty", "DDD", "e f"]) for _ in range(n))
        for words in (1, 3, 5):
            assert simhash.fingerprint(t.encode(), words) == slow_fingerprint(t, words)
    assert simhash.fingerprint(None, 3) == 0


def test_fingerprint_of_long_text_crosses_blocks():
    t = " ".join(str(i * 7919) for i in range(400_000))
    assert simhash.fingerprint(t.encode(), 3) == slow_fingerprint(t, 3)


def test_links_match_brute_force_with_and_without_crowded_keys(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = slow_groups(dict(enumerate(fps)))
    for paired in (2, 10_000):
        df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
        got = simhash.components(simhash.links(df, paired=paired)).collect()
        label = {r.node: r.label for r in got}
        ids = [label.get(simhash.signed(f), simhash.signed(f)) for f in fps]
        assert {(i, j) for i in want for j in want if want[i] == want[j]} == {
            (i, j) for i in range(len(ids)) for j in range(len(ids)) if ids[i] == ids[j]}


def test_groups_edge_cases(spark):
    rows = [(1, ""), (2, None), (5, "a b c d"), (4, "A b  c D"), (None, "a b c d"), (7, "x"), (7, "x"), (None, "lonely row of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs, words=3).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (5, 4), (4, 4), (None, 4), (7, 7), (7, 7), (None, None)], key=str)
    kept = simhash.keep_one(spark, docs, words=3)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "7", "7", "None", "None"]
    empty = docs.where("false")
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(spark, empty).count() == 0


def test_query_on_small_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint(r.text, 3) for r in docs}
    want = slow_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def jaccard(a, b, words=5):
    x, y = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_texts_meet_and_others_do_not(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([40, 150, 600, 3000]))]
        other = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 40))):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert all(got[2 * k] == 2 * k for k in range(60))
    sure = [k for k, j in enumerate(pairs) if j >= 0.88]
    assert len(sure) > 15 and sum(got[2 * k + 1] == 2 * k for k in sure) >= 0.95 * len(sure)
    assert all(got[2 * k + 1] == 2 * k + 1 for k, j in enumerate(pairs) if j < 0.68)


def test_shared_part_is_exact_for_short_texts():
    import numpy as np

    a, b = np.arange(0, 100, dtype=np.uint64), np.arange(20, 110, dtype=np.uint64)
    assert simhash.shared_parts([a.tobytes(), b""], [b.tobytes(), b""]).tolist() == [80 / 110, 0.0]


def test_links_that_no_end_of_a_class_shows(spark):
    own = spark.createDataFrame([(i, 100, [7]) for i in range(6)], "row long, n long, keys array<bigint>")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, label long")
    got = {(r.a, r.b) for r in simhash.open_pairs(own, labels).collect()}
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6)} - {(1, 2)}


def test_every_similar_pair_of_a_crowded_class_is_linked(spark):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for k in range(40):
        # two thirds of each text are common to all, so that classes meet; the rest is shared by two texts
        own = [f"o{k // 2}x{i}" for i in range(150)]
        own[rng.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(shared + own)))
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert len(pairs) == 20
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == 20


def test_every_pair_of_short_and_long_texts_shares_a_key():
    import numpy as np

    rng = np.random.default_rng(8)
    for n in (5, 6, 7, 10, 20, 46, 100, 199, 200, 230, 250, 251, 400, 2000):
        for _ in range(100):
            both = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            k = int(n * 0.2) if rng.random() < 0.5 else int(n / 9)
            other = both[k:] if k == int(n * 0.2) else np.concatenate([both[k:], rng.integers(0, 1 << 64, k, dtype=np.uint64)])
            a, b = np.unique(both), np.unique(other)
            if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            frequent = np.sort(rng.choice(a, n // 2, replace=False) >> np.uint64(64 - simhash.COUNT_BITS)).astype(np.int64)
            counts = frequent % 5 + 8
            x, y = (np.concatenate([simhash.prefix_keys(h, (frequent, counts)), simhash.class_keys(h)]) for h in (a, b))
            assert len(np.intersect1d(x, y)), n


def test_short_near_copies_are_linked(spark):
    rows = []
    for k in range(30):
        words = [f"t{k}w{i}" for i in range(11)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:10]))]
    assert all(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(30))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d in range(60)}


def test_shared_parts_of_samples_match_plain_sets():
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(10**15)) for n in (0, 1, 30, 120, 300, 900, 900)]
    pairs = [(x, y) for x in texts for y in texts]
    got = simhash.shared_parts([x[: simhash.SAMPLE].tobytes() for x, _ in pairs], [y[: simhash.SAMPLE].tobytes() for _, y in pairs])
    for (x, y), part in zip(pairs, got, strict=True):
        x, y = x[: simhash.SAMPLE], y[: simhash.SAMPLE]
        both = sorted({*x.tolist(), *y.tolist()})
        if simhash.SAMPLE in (len(x), len(y)):
            both = both[: simhash.SAMPLE]
        assert part == (sum(v in x and v in y for v in both) / len(both) if both else 0.0)


def test_parities_lose_no_similar_pair_and_drop_far_ones(spark):
    rng = np.random.default_rng(3)
    rows, want, far = [], set(), set()
    for k in range(200):
        n = int(rng.integers(1, 600))
        base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        swap = int(rng.integers(0, n // 3 + 1))
        other = np.concatenate([base[swap:], rng.integers(1, 1 << 63, swap, dtype=np.uint64)])
        part = (n - swap) / (n + swap)
        (want if part >= 0.8 else far).add((2 * k, 2 * k + 1))
        rows += [(2 * k + i, n, simhash.parities(x).tolist()) for i, x in enumerate((base, other))]
    own = spark.createDataFrame([*rows, (1000, 0, simhash.parities(base[:0]).tolist())], "row long, n long, bits array<bigint>")
    pairs = spark.createDataFrame(sorted(want | far), "a long, b long")
    got = {(r.a, r.b) for r in simhash.possible(own, pairs).collect()}
    assert want <= got and len(got & far) < len(far) / 2


def test_shingles_are_counted_over_all_rows(spark):
    rng = random.Random(6)
    texts = [f"one two three four five {i}" for i in range(9000)] + [" ".join(f"v{i}" for i in range(300))] * 40
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts, frequent = simhash.frequent_shingles(docs, 5)
    short, long = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for t in texts:
        hashes = simhash.distinct_hashes(t.encode(), 5).astype(np.uint64)
        np.add.at(long if len(hashes) >= simhash.LONG else short, simhash.bucket_of(hashes), 1)
    assert short.max() >= 9000 and (counts == simhash.stepped(short)).all()
    assert (frequent == (long >= 40)).all()


def test_copies_with_many_edits_do_not_meet_all_others(spark):
    rng = random.Random(12)
    base, rows = [f"b{i}" for i in range(104)], []
    for k in range(150):
        words = list(base)
        # neither the first nor the last row of a key is similar to most
        for i in rng.sample(range(5, 99), 0 if k == 75 else 1 if 30 <= k < 120 else 2):
            words[i] = f"e{k}x{i}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = save(simhash.sketches(docs, 5), "sketches")
    labels = simhash.components(simhash.similar_links(own, simhash.end_pairs(own)))
    assert simhash.open_pairs(own, labels).count() < 2 * len(rows)
    group, got = list(range(150)), {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    for a in range(150):
        for b in range(a):
            near = (simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() <= 2
            if group[a] != group[b] and (near or jaccard(rows[a][1], rows[b][1]) >= 0.8):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert got == dict(enumerate(group))


def test_common_passage_is_no_class_key_unless_it_is_most_of_the_text():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    frequent = np.zeros(1 << simhash.COUNT_BITS, bool)
    frequent[simhash.bucket_of(passage)] = True
    plain, own = 0, []
    for _ in range(40):
        text = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        fresh = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
        both = [np.unique(np.concatenate([passage, x])) for x in (text, np.concatenate([text[30:], fresh]))]
        x, y = (simhash.class_keys(b, frequent=frequent) for b in both)
        assert len(np.intersect1d(x, y)) > 5
        plain, own = plain + len(own and np.intersect1d(own[0], simhash.class_keys(both[0]))), [*own, simhash.class_keys(both[0])]
        assert not own[1:] or not len(np.intersect1d(x, simhash.class_keys(first, frequent=frequent)))
        first = both[0]
    assert plain > 0
    most = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 20, dtype=np.uint64)])) for _ in range(2)]
    x, y = (simhash.class_keys(b, frequent=frequent) for b in most)
    assert len(np.intersect1d(x, y)) > 5


def test_long_copies_with_many_edits_of_their_own_do_not_meet(spark):
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(400)], []
    for k in range(120):
        words = list(base)
        # too far from all others, but for two rows that share their edits; a third is near the base
        for i in rng.sample(range(400), 20 if k % 3 else 2):
            words[i] = f"e{k}x{i}"
        rows.append((2 * k, " ".join(words)))
        if k % 10 == 1:
            words[rng.randrange(400)] = "last"
            rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = save(simhash.sketches(docs, 5), "sketches")
    labels = simhash.components(simhash.similar_links(own, simhash.end_pairs(own)))
    assert simhash.open_pairs(own, labels).count() < 8 * len(rows)
    # nothing is joined before: the head of the keys and the links of small groups come from crowded keys alone
    none = spark.createDataFrame([], "node long, label long")
    found = simhash.similar_links(own, simhash.open_pairs(own, none)).collect()
    of = {r.row: r.doc_id for r in own.select("row", "doc_id").collect()}
    text = dict(rows)
    assert all(jaccard(text[of[r.a]], text[of[r.b]]) >= 0.8 for r in found)
    group = {d: d for d in text}
    for a in text:
        for b in text:
            if a < b and group[a] != group[b] and jaccard(text[a], text[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert len(set(group.values())) == 81
    linked = {of[r.node]: of[r.label] for r in simhash.components(spark.createDataFrame(found)).collect()}
    same = lambda g: {(a, b) for a in text for b in text if g.get(a, a) == g.get(b, b)}
    assert same(linked) == same(group)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == group
