"""Phrase collocations: words that stand together more often than their own counts suggest, counted in HAT-tries.

Every task counts phrases of up to three words in a burst trie over word ids: under a first word lies a hash container
from the packed ids of what follows to a count; a container that outgrows its limit bursts into a node with one container
per second word. When a trie holds too much, its largest subtrees leave whole, as runs sorted by words and cut at prefix
partitions (language and the first two words by hash), and counting goes on. Runs of one prefix partition then meet in one
place and are merged by their order, each partition of bounded size as their number grows with the input. Counts below
the limit of a candidate go there: no part of a phrase can be rarer than the phrase. Scores are joins over what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, drop, prepare, save

#: Bytes of text that are counted at once; entries of a trie before subtrees leave it, and of a container before it bursts.
CHUNK, ENTRIES, BURST = 2 << 20, 1_300_000, 4096
#: Bits of a word's number in a packed phrase, and words after which a trie leaves whole and starts again. Two
#: chunks have fewer distinct words than lie between the two.
BITS, WORDS = 21, 500_000
MASK, LOW = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Bytes of input, as stored, for each prefix partition, and the most partitions.
PART_BYTES, MOST_PARTS = 1 << 20, 1 << 20
#: Parts of a language whose candidates are ranked by themselves.
RANK_PARTS = 64
#: What ends a piece of text, as "."; a tab is a space.
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
UNKNOWN = "und"


class Words(dict):
    """Numbers of words as they come, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(text: str) -> Iterator[bytes]:
    """The text in lower case (A-Z only) with pieces ended by a word ".", cut between words into bounded parts."""
    data, start = text.encode(), 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        while end < len(data) and data[end] not in b" \t":
            end += 1
        yield data[start:end].lower().translate(PLAIN).replace(b".", b" . ")
        start = end


class Trie:
    """A burst trie of packed phrases: {first word: {what follows: count}} or, once burst, {first: {second: {third: count}}}."""

    def __init__(self):
        self.words, self.roots, self.burst, self.sizes, self.total = Words(), {}, set(), {}, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """`keys` sorted and distinct."""
        if not len(keys):
            return
        first = keys >> (2 * BITS)
        cuts = np.flatnonzero(np.diff(first, prepend=-1))
        rest = (keys & LOW).tolist()
        n = counts.tolist()
        for a, b, w in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rest)], first[cuts].tolist(), strict=True):
            box = self.roots.get(w)
            if box is None:
                self.roots[w] = dict(zip(rest[a:b], n[a:b], strict=True))
                self.sizes[w] = b - a
                self.total += b - a
                continue
            if w in self.burst:
                grown = 0
                for k, c in zip(rest[a:b], n[a:b], strict=True):
                    under = box.get(k >> BITS)
                    if under is None:
                        under = box[k >> BITS] = {}
                    third = k & MASK
                    grown += third not in under
                    under[third] = under.get(third, 0) + c
            else:
                before = len(box)
                for k, c in zip(rest[a:b], n[a:b], strict=True):
                    box[k] = box.get(k, 0) + c
                grown = len(box) - before
                if len(box) > BURST:
                    node: dict[int, dict[int, int]] = {}
                    for k, c in box.items():
                        node.setdefault(k >> BITS, {})[k & MASK] = c
                    self.roots[w] = node
                    self.burst.add(w)
            self.sizes[w] += grown
            self.total += grown

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed phrases and counts of the largest subtrees, taken out until at most `keep` entries stay."""
        heads, boxes, sizes = [], [], []
        for w in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.total <= keep:
                break
            box, size = self.roots.pop(w), self.sizes.pop(w)
            self.total -= size
            if w in self.burst:
                self.burst.discard(w)
                heads += [w << 2 * BITS | second << BITS for second in box]
                boxes += box.values()
                sizes += map(len, box.values())
            else:
                heads.append(w << 2 * BITS)
                boxes.append(box)
                sizes.append(size)
        total = sum(sizes)
        keys = np.fromiter(chain.from_iterable(boxes), np.int64, total) | np.repeat(np.array(heads, np.int64), sizes)
        return keys, np.fromiter(chain.from_iterable(box.values() for box in boxes), np.int64, total)


def packed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed phrases of one to three words that end after the first two of `words` (numbers, 0 ends a piece),
    and their counts."""
    a, b, c = words[:-2], words[1:-1], words[2:]
    one = c[c > 0] << 2 * BITS
    two = (b << 2 * BITS | c << BITS)[(b > 0) & (c > 0)]
    three = (a << 2 * BITS | b << BITS | c)[(a > 0) & (b > 0) & (c > 0)]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def runs(trie: Trie, keep: int, parts: int, lang: str) -> Iterator[tuple[int, str, int, bytes, bytes]]:
    """(prefix partition, language, occurrences of single words, phrases in the order of their words, counts) of what
    leaves the trie, the last two compressed. Phrases are lines of three words, of which the last can be empty."""
    keys, counts = trie.take(keep)
    if not len(keys):
        return
    words = list(trie.words)
    words[0] = b""
    first, second, third = keys >> 2 * BITS, keys >> BITS & MASK, keys & MASK
    used = np.unique(np.concatenate([first, second, third])).tolist()
    seed = xxhash.xxh64_intdigest(lang)
    rank, hashes = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
    rank[sorted(used, key=words.__getitem__)] = np.arange(len(used)) + (used[0] > 0)
    hashes[used] = [xxhash.xxh64_intdigest(words[k], seed) for k in used]
    hashes[0] = 0
    part = ((hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second]) % np.uint64(parts)).astype(np.int64)
    place = np.lexsort((rank[first] << 2 * BITS | rank[second] << BITS | rank[third], part))
    part, counts, alone = part[place], counts[place], np.where(second[place] == 0, counts[place], 0)
    plain, ended = pa.array(words, pa.large_binary()), pa.array([w + b"\n" for w in words], pa.large_binary())
    text = pc.binary_join_element_wise(plain.take(first[place]), plain.take(second[place]), ended.take(third[place]), pa.scalar(b" ", pa.large_binary()))
    offsets, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2])
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    squeeze = zstandard.ZstdCompressor(level=3)
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        phrases = squeeze.compress(data[offsets[a] : offsets[b] - 1])
        yield int(part[a]), lang, int(alone[a:b].sum()), phrases, squeeze.compress(counts[a:b].astype("<i8").tobytes())


RUNS = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    now: list[tuple] = []
    for r in rows:
        now.append(r)
        if len(now) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*now, strict=True), schema.types, strict=True)], schema=schema)
            now = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*now, strict=True), schema.types, strict=True)], schema=schema)


def task_runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """Runs of one task's rows (lang, text)."""
    tries: dict[str, Trie] = {}
    waiting: dict[str, list[bytes]] = {}
    # the last two words of what was counted of a language: a long text goes on after them
    carried: dict[str, list[bytes]] = {}
    held = 0

    def count(lang: str) -> Iterator[tuple]:
        trie = tries.setdefault(lang, Trie())
        found = carried.get(lang, [b"."] * 2) + b"".join(waiting.pop(lang)).split()
        carried[lang] = found[-2:]
        trie.add(*packed(np.fromiter(map(trie.words.__getitem__, found), np.int64, len(found))))
        if len(trie.words) > WORDS:
            yield from runs(trie, 0, parts, lang)
            tries.pop(lang)
        elif sum(t.total for t in tries.values()) > ENTRIES:
            large = max(tries, key=lambda k: tries[k].total)
            yield from runs(tries[large], tries[large].total // 4, parts, large)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for data in chunks(text):
                waiting.setdefault(lang, []).append(data)
                held += len(data)
                if held > CHUNK:
                    for k in list(waiting):
                        yield from count(k)
                    held = 0
            waiting.setdefault(lang, []).append(b" . ")
    for k in list(waiting):
        yield from count(k)
    for k, trie in tries.items():
        yield from runs(trie, 0, parts, k)


def task_merges(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    """(lang, words, phrase, n) of all phrases of n >= `least`, and (lang, 0, "", occurrences of words), of one task's
    runs, which come by prefix partition and language."""
    opened = zstandard.ZstdDecompressor()

    def merge(lang: str, total: int, of: list[tuple[bytes, bytes]]) -> Iterator[tuple]:
        if total:
            yield lang, 0, "", total
        phrases: list[bytes] = []
        for p, _ in of:
            phrases += opened.decompress(p).split(b"\n")
        counts = np.concatenate([np.frombuffer(opened.decompress(c), "<i8") for _, c in of])
        # sorting finds the sorted runs and merges them
        order = sorted(range(len(phrases)), key=phrases.__getitem__)
        merged = list(map(phrases.__getitem__, order))
        starts = np.flatnonzero(np.fromiter(chain((True,), map(ne, merged[1:], merged)), bool, len(merged)))
        sums = np.add.reduceat(counts[order], starts)
        for k in np.flatnonzero(sums >= least).tolist():
            phrase = merged[starts[k]].rstrip(b" ")
            yield lang, phrase.count(b" ") + 1, phrase.decode(), int(sums[k])

    now, total, of = None, 0, []
    for b in batches:
        for part, lang, n, p, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (part, lang) != now:
                if of:
                    yield from merge(now[1], total, of)
                now, total, of = (part, lang), 0, []
            total += n
            of.append((p, c))
    if of:
        yield from merge(now[1], total, of)


def counts(docs: DataFrame, least: int, parts: int | None = None) -> DataFrame:
    """lang, words, phrase, n of every phrase of one to three words with n >= `least` occurrences in a language, and one
    or more rows (lang, 0, "", n) whose n sum up to all word occurrences of the language."""
    prepare(docs.sparkSession)
    if parts is None:
        stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        parts = min(MOST_PARTS, max(64, stored // PART_BYTES))
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.coalesce(F.col("text").cast("string"), F.lit("")))
    dealt = own.mapInArrow(lambda b: batches_of(task_runs(b, parts), RUNS, 256), "part long, lang string, total long, phrases binary, counts binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(lambda b: batches_of(task_merges(b, least), COUNTS, 10_000), "lang string, words int, phrase string, n long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts of up to 14 digits."""
    short, long = "decimal(14,0)", "decimal(19,0)"
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a.cast(short) * a.cast(short), left.cast(long) * right.cast(long))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, parts: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of two and three words of every language.

    A-Z count as lower case; pieces end at `[.,;:!?]` and line ends, words at spaces and tabs. Candidates stand `least`
    times or more. Of the cuts of a phrase in two the one of the lowest score counts, and of equal ones the first. Two
    words go where a longer candidate holds them and has at least `share` hundredths of their occurrences. Order is by
    score and a, falling, and the bytes of the phrase. A null lang is "und", a null text empty; repeated rows count each;
    texts of any length are counted in parts that overlap by two words; other columns are not looked at; no rows, or no
    candidates, give no rows.
    """
    known = save(counts(docs, least, parts), "phrases")
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    found = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), words.alias("ws"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = known.where("words > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b"))
    inner = found.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    # a language may hold most candidates: the first of each part of it are ranked again together
    parts = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.desc("b.score"), F.desc("a"), "phrase"]
    for keys in (["lang", "part"], ["lang"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    first = parts
    totals = known.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


#: The same in SQL; DuckDB's regular expressions know the line ends by number.
OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
  from documents),
words as (select lang, row_number() over () as piece, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') as ws from pieces),
places as (select lang, piece, unnest(ws) as w, generate_subscripts(ws, 1) as i from words),
near as (select lang, w as w1, lead(w) over p as w2, lead(w, 2) over p as w3 from places window p as (partition by piece order by i)),
f as (
  select lang, k, phrase, count(*) as n
  from (select lang, 1 as k, w1 as phrase from near
        union all select lang, 2, w1 || ' ' || w2 from near where w2 is not null
        union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from near where w3 is not null)
  group by all),
candidates as (select lang, k, phrase, n as a, string_split(phrase, ' ') as ws from f where k > 1 and n >= 10),
parts as (select lang, k, phrase, n from f where n >= 10),
halves as (
  select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as rest
  from (select *, unnest(range(1, k)) as j from candidates)),
lefts as materialized (select h.*, x.n as l from halves h join parts x on x.lang = h.lang and x.phrase = h.head),
cuts as (
  select h.lang, h.phrase, a, j, l, y.n as r, 1000000::hugeint * a * a // (l::hugeint * y.n) as score
  from lefts h join parts y on y.lang = h.lang and y.phrase = h.rest),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, phrase, max(a) as longer
  from (select lang, ws[1] || ' ' || ws[2] as phrase, a from candidates where k = 3
        union all select lang, ws[2] || ' ' || ws[3], a from candidates where k = 3)
  group by all),
kept as (select b.* from best b left join inside i using (lang, phrase) where coalesce(100 * i.longer < 50 * b.a, true)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept),
totals as (select lang, sum(n)::bigint as n from f where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
