import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spreadloom.llm import packing

TEXTS = [
    "", None, " ", "Hello, World!! it's I'LL 12 3.4", "ÉÀ ñandú İstanbul ΣΑΣ straße ﬁ Å", "a\tb c\nd\x1ce　f", "<|endoftext|> x<|startoftext|>.", "don't.'s ...a,.b ''re'", "日本語 текст ǅ ªº é. ́x",
    "word " * 5000, "x" * 3000, "*** $$$ a&&& b%%%", "'s's .'t",
]


def test_words_encode_as_the_whole_text_does():
    t = Tokenizer.from_file(packing.word_tokenizer())
    own = packing.Encoder(packing.word_tokenizer())
    assert own.by_word
    for x in TEXTS:
        assert np.frombuffer(own.ids(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_words_of_all_cased_letters_before_punctuation():
    import sys
    import unicodedata

    t = Tokenizer.from_file(packing.word_tokenizer())
    own = packing.Encoder(packing.word_tokenizer())
    cased = [chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c)) in ("Lu", "Lt") or len(chr(c).lower()) > 1]
    rng = random.Random(8)
    alphabet = [*"aeİİİΣΣéßı", *"\u0301\u0307", *cased]
    words = [c + "," for c in cased] + ["".join(rng.choice(alphabet[: rng.choice([12, len(alphabet)])]) for _ in range(rng.randrange(1, 5))) + "".join(rng.choice(".,;:!?|*#%$&'-İ") for _ in range(rng.randrange(1, 4))) for _ in range(100_000)]
    texts = [" ".join(words[k : k + 20]) for k in range(0, len(words), 20)] + ["BELEDİYESİ, İ. İ"]
    for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(x), "<u4").tolist() == want.ids, x


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.Encoder(path)
    assert not own.by_word
    assert np.frombuffer(own.ids("a b  c"), "<u4").tolist() == Tokenizer.from_file(path).encode("a b  c", add_special_tokens=False).ids


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        ok = [g for g in gaps if g >= x]
        if ok:
            gaps.remove(min(ok))
            gaps.append(min(ok) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("size", [packing.RANGE_ROWS, 40])
def test_place_needs_as_few_sequences_as_best_fit(spark, monkeypatch, size):
    # in one range, and in several
    monkeypatch.setattr(packing, "RANGE_ROWS", size)
    rng = random.Random(2)
    for capacity, most in ((10, 10), (64, 40), (100, 100), (7, 1)):
        lengths = [rng.randint(1, most) for _ in range(300)]
        pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
        rows = packing.placed(pieces, capacity).collect()
        assert sorted(r.row for r in rows) == list(range(300))
        taken = defaultdict(list)
        for r in rows:
            taken[r.sequence_id].append((r.offset, lengths[r.row]))
        for own in taken.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(taken) <= best_fit(lengths, capacity) + 1


def test_sweep_is_a_successor_matching_over_any_ranges(spark):
    rng = random.Random(5)
    gaps, lengths = [rng.randint(1, 50) for _ in range(120)], [rng.randint(1, 50) for _ in range(150)]
    want, free = {}, sorted(gaps)
    for row in sorted(range(150), key=lambda r: -lengths[r]):
        fit = [g for g in free if g >= lengths[row]]
        want[row] = min(fit) if fit else None
        if fit:
            free.remove(min(fit))
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        swept = packing.save(packing.sweep(spark.createDataFrame(list(enumerate(gaps)), "sequence_id long, gap long"), spark.createDataFrame(list(enumerate(lengths)), "row long, length long"), 50, n))
        got = [(lengths[r.row], None if r.sequence_id is None else gaps[r.sequence_id]) for r in packing.settled(swept, n).collect()]
        assert sorted(got, key=str) == sorted(((lengths[r], g) for r, g in want.items()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def check(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "dup"), (None, "dup"), (3, "dup")], "doc_id long, text string").withColumn("row", F.lit("clash"))
    rows = packing.pack(docs, packing.word_tokenizer()).collect()
    check(rows)
    t = Tokenizer.from_file(packing.word_tokenizer())
    long = np.array(t.encode("word " * 5000, add_special_tokens=False).ids + [0], "<u4")
    own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 9)
    assert own == [(k, k * 2048, len(long[k * 2048 : k * 2048 + 2048]), zlib.crc32(long[k * 2048 : k * 2048 + 2048].tobytes())) for k in range(3)]
    assert sum(r.doc_id is None for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (0, 1)] == [1, 1]
    assert packing.pack(docs.where("false"), packing.word_tokenizer()).count() == 0


def test_query_packs_every_token_of_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(packing.word_tokenizer())
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    rows = packing.op4_best_fit(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check(rows)
    assert n <= best_fit([w[1] for w in want.values()], 2048)


def test_plain_words_are_encoded_without_normal_forms(monkeypatch):
    own = packing.Encoder(packing.word_tokenizer())
    text = "Plain words, ALL of them; Zyxquorble! aBc x"
    want = np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(packing, "unicodedata", None)
    assert own.ids(text) == want
