"""Removal of bytes in long strings that occur more than once, by a logarithmic index family.

A string of `LENGTH` bytes is removed wherever it stands if it starts in two places. Suffixes are indexed where they can
matter: every such string holds an anchor, the smallest hash among its runs of `GRAM` bytes, so equal strings have their
anchors at one place, and the strings with one anchor in one half share a stretch around it. An entry of the index is
such a stretch (its fingerprint is the key), with the context that all strings of the entry cover.

Documents come in batches. The entries of a batch are sorted into an array, the array is scanned against every level of
the family by a merge join, which finds the stretches that both hold, and levels of equal size merge, so an entry is
rewritten a number of times that grows with the logarithm of the number of batches. Levels are tables in the shared
folder. The order is by fingerprint and not alphabetical, as only equality is asked for. A stretch that neither repeats
in its batch nor meets another level holds no repeated string, and most end here.

Of entries on a repeated stretch those whose whole contexts are equal repeat with all their strings. What is left,
different contexts on one stretch, is compared string by string: a group of up to `CROWD` contexts in one task, a larger
one as rows that are counted by fingerprint.

The same entries over words in place of bytes find passages of `WORDS` words or more that stand in two places, however
few bytes they have; of these the words are counted, nothing is removed for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, drop, prepare, save

LENGTH, GRAM = 400, 32
#: Words of a passage; words of its anchor.
WORDS, WORD_GRAM = 51, 8
#: Contexts of one stretch that one task compares; batches in which a table of documents is added to the family.
CROWD, BATCHES = 4096, 6
#: Symbols whose anchors are found at once.
STRIDE = 1 << 22

MIX = np.array([xxhash.xxh32_intdigest(bytes([i]), 11) for i in range(256)], np.uint32)
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
VALUES = np.array([[xxhash.xxh64_intdigest(bytes([i]), s) for i in range(256)] for s in (1, 2)], np.uint64)


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse, up to the n-th."""
    if k not in POWERS or len(POWERS[k][0]) < n + 1:
        one = [np.uint64(1)]
        up = np.concatenate([one, np.full(n * 2, BASES[k])]).cumprod(dtype=np.uint64)
        down = np.concatenate([one, np.full(n * 2, np.uint64(pow(int(BASES[k]), -1, 1 << 64)))]).cumprod(dtype=np.uint64)
        POWERS[k] = up, down
    return POWERS[k]


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], by differences of one running sum."""
    up, down = powers(k, len(values))
    total = np.concatenate([[np.uint64(0)], (values * up[: len(values)]).cumsum(dtype=np.uint64)])
    return (total[ends] - total[starts]) * down[starts]


def words_of(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], BLANK[a], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = spans_hashed(VALUES[0][a], starts, ends, 0)
    h = (h ^ (h >> np.uint64(31))) * BASES[1]
    return h ^ (h >> np.uint64(29))


def symbols(data: bytes, unit: int) -> np.ndarray:
    """The bytes of a text (unit 0) or the hashes of its words (unit 1)."""
    return words_of(data) if unit else np.frombuffer(data, np.uint8)


def anchors(a: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of strings of `length` symbols with one anchor; `gram` is a power of 2."""
    width = length - gram + 1
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, max(0, len(a) - length + 1), STRIDE):
        part = a[at : at + STRIDE + length - 1]
        h = MIX[part] if part.dtype == np.uint8 else (part >> np.uint64(32)).astype(np.uint32)
        s = 1
        while s < gram:
            h[s:] += h[:-s] << np.uint32(s)
            s *= 2
        h = h[gram - 1 :] * np.uint32(2654435761)
        best = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if width > size:
            best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
        place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        low, high = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(place) - 1]])
        for x, y in zip(found, (place[low] + at, low + at, high + at), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)  # type: ignore[return-value]


def entries_of(a: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(key, context, first start, last start): strings whose anchor lies in one half, by the stretch they share."""
    out = []
    half, u = (length - gram) // 2, a.itemsize
    data, seed = a.tobytes(), u
    key64 = xxhash.xxh3_64_intdigest
    for at, low, high in zip(*(x.tolist() for x in anchors(a, length, gram)), strict=True):
        mid = at - half
        for first, last, core in ((low, min(high, mid), data[u * mid : u * (at + gram)] if mid >= 0 else b""), (max(low, mid + 1), high, data[u * at : u * (at + length - half + 1)])):
            if first <= last:
                out.append((key64(core, seed) - (1 << 63), key64(data[u * first : u * (last + length)], at - first) - (1 << 63), first, last))
    return out


def digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def texts(docs: DataFrame) -> DataFrame:
    """d1 and d2 (digest of the text) and the text as bytes; copies within a partition of `docs` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t and (d := digest(t)) not in seen:
                    seen.add(d)
                    rows.append((*d, t))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["d1", "d2", "data"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "d1 long, d2 long, data binary")


#: Lowest bits of `at`: further starts of an entry, then its unit, then its first start.
RUN_BITS = 10


def entries(docs: DataFrame, length: int, words: int) -> DataFrame:
    """key, ctx, d1, d2, at of every text over bytes, and over words if `words` is not 0."""
    units = [(0, length, GRAM), *([(1, words, WORD_GRAM)] if words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(5)]
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if not t or (d := digest(t)) in seen:
                    continue
                seen.add(d)
                for unit, n, gram in units:
                    got = entries_of(symbols(t, unit), n, gram)
                    cols[0] += [k for k, _, _, _ in got]
                    cols[1] += [c for _, c, _, _ in got]
                    cols[2] += [d[0]] * len(got)
                    cols[3] += [d[1]] * len(got)
                    cols[4] += [(x << 1 | unit) << RUN_BITS - 1 | (y - x) for _, _, x, y in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "ctx", "d1", "d2", "at"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, ctx long, d1 long, d2 long, at long")


class Family:
    """Levels of sorted keys in the shared folder, largest first, with the number of batches that each holds."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def array(keys: DataFrame) -> DataFrame:
        """Equal keys merged (n: how many), in order within the partitions by key."""
        return save(keys.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "level")

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the keys of `batch` and return those that occur twice in it or once more in a level."""
        new, size = self.array(batch.select("key", F.lit(1).cast("long").alias("n"))), 1
        hits = new.where("n > 1").select("key")
        for _, level in self.levels:
            hits = hits.union(new.select("key").join(level.select("key"), "key"))
        hits = save(hits.distinct(), "hits")
        while self.levels and self.levels[-1][0] <= size:
            n, old = self.levels.pop()
            merged = self.array(old.union(new))
            drop(old, new)
            new, size = merged, size + n
        self.levels.append((size, new))
        return hits

    def close(self) -> None:
        drop(*(level for _, level in self.levels))


def fingerprints(a: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of each string of `length` symbols."""
    starts = np.arange(len(a) - length + 1)
    values = [VALUES[k][a] if a.dtype == np.uint8 else a * BASES[1 - k] for k in (0, 1)]
    return np.stack([spans_hashed(v, starts, starts + length, k) for k, v in enumerate(values)], axis=1)


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers, which are in order."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


Member = tuple[int, int, int, bytes, bool]


def context(at: int, data: bytes, lengths: tuple[int, int]) -> tuple[np.ndarray, int, int, int]:
    """Symbols of a context, the length of its strings, its unit and its first start."""
    unit = at >> RUN_BITS - 1 & 1
    return np.frombuffer(data, np.uint64 if unit else np.uint8), lengths[unit], unit, at >> RUN_BITS


def decided(members: list[Member], lengths: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """Repeated starts among the contexts of one key (d1, d2, at, data, asked): (d1, d2, unit, run) of those asked."""
    known = [context(at, data, lengths) for _, _, at, data, _ in members]
    prints = [fingerprints(a, n) for a, n, _, _ in known]
    every = np.concatenate(prints)
    order = np.lexsort((every[:, 1], every[:, 0]))
    same = (every[order[1:]] == every[order[:-1]]).all(axis=1)
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out, base = [], 0
    for (d1, d2, _, _, asked), (_, _, unit, first), p in zip(members, known, prints, strict=True):
        if asked:
            out += [(d1, d2, unit, first + x << 32 | first + y) for x, y in runs_of(np.flatnonzero(twice[base : base + len(p)]))]
        base += len(p)
    return out


RUNS = "d1 long, d2 long, unit long, run long"


def as_runs(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["d1", "d2", "unit", "run"])


def compared(contexts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """Runs of repeated starts within groups of one key; `contexts` has key, d1, d2, at, data, asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for b in batches:
            for k, *m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    out += decided(members, lengths) if len(members) > 1 else []
                    key, members = k, []
                members.append(tuple(m))
            if len(out) > 5000:
                yield as_runs(out)
                out = []
        yield as_runs(out + (decided(members, lengths) if len(members) > 1 else []))

    rows = contexts.select("key", "d1", "d2", "at", "data", "asked").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, RUNS)


def counted(contexts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """As `compared`, for groups of any size: one row per string, counted by fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d1, d2, at, data, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, length, unit, first = context(at, data, lengths)
                p = fingerprints(a, length).astype(np.int64)
                n = len(p)
                cols = (np.full(n, d1), np.full(n, d2), np.full(n, unit), np.arange(first, first + n), p[:, 0].copy(), p[:, 1].copy())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([asked] * n)], names=["d1", "d2", "unit", "start", "p1", "p2", "asked"])

    rows = contexts.select("d1", "d2", "at", "data", "asked").mapInArrow(run, "d1 long, d2 long, unit long, start long, p1 long, p2 long, asked boolean")
    twice = save(rows.groupBy("p1", "p2").agg(F.count("*").alias("n")).where("n > 1").select("p1", "p2"), "twice")
    hit = rows.where("asked").join(twice, ["p1", "p2"])
    return hit.select("d1", "d2", "unit", (F.shiftleft("start", 32).bitwiseOR(F.col("start"))).alias("run"))


def repeated_stretches(docs: DataFrame, length: int, words: int, batches: int) -> DataFrame:
    """Entries (key, ctx, d1, d2, at) on stretches that occur twice, by adding `docs` to an index family batch by batch."""
    found = entries(docs, length, words).withColumn("batch", F.pmod("d1", F.lit(batches)).cast("int"))
    every = save(found, "entries", by="batch")
    family, hits = Family(), []
    for k in range(batches):
        hits.append(family.add(every.where(F.col("batch") == k)))
    family.close()
    twice = hits[0]
    for more in hits[1:]:
        twice = twice.union(more)
    twice = save(twice.distinct(), "twice")
    shared = save(every.drop("batch").join(twice, "key"), "shared")
    drop(every, twice, *hits)
    return shared


def repeated_starts(docs: DataFrame, length: int = LENGTH, words: int = WORDS, crowd: int = CROWD, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Runs of repeated starts (d1, d2, runs and word_runs: arrays of first * 2**32 + last), and the texts (d1, d2, data)
    that have any entry on a repeated stretch."""
    shared = repeated_stretches(docs, length, words, batches)
    first, more = F.shiftright("at", RUN_BITS), F.col("at").bitwiseAND(F.lit((1 << RUN_BITS - 1) - 1))
    unit = F.shiftright("at", RUN_BITS - 1).bitwiseAND(F.lit(1).cast("long"))
    alike = save(shared.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "at")).alias("rep")), "alike")
    mixed = save(alike.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    equal = save(alike.where("n > 1").select("key", "ctx"), "equal")
    whole = shared.join(equal, ["key", "ctx"]).select("d1", "d2", unit.alias("unit"), (F.shiftleft(first, 32).bitwiseOR(first + more)).alias("run"))
    # each context once: the only one of its kind is asked about, one of several stands for them
    wanted = alike.join(mixed, "key").select("key", "rep.d1", "rep.d2", "rep.at", (F.col("n") == 1).alias("asked"), (F.col("m") > crowd).alias("crowded"))
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "at", "asked", "crowded")).alias("wanted"))
    have = save(shared.select("d1", "d2").distinct().join(wanted, ["d1", "d2"], "left"), "have")
    some = texts(docs).join(have, ["d1", "d2"]).dropDuplicates(["d1", "d2"])
    some = save(some.select("d1", "d2", "data", "wanted"), "some")
    lengths = (length, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d1, d2, data, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = {}
                for w in wanted:
                    at = w["at"]
                    kind, x = at >> RUN_BITS - 1 & 1, at >> RUN_BITS
                    if kind not in own:
                        own[kind] = symbols(data, kind)
                    rows.append((w["key"], d1, d2, at, own[kind][x : x + (at & (1 << RUN_BITS - 1) - 1) + lengths[kind]].tobytes(), w["asked"], w["crowded"]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "d1", "d2", "at", "data", "asked", "crowded"])

    contexts = some.where("wanted is not null").select("d1", "d2", "data", "wanted").mapInArrow(
        run, "key long, d1 long, d2 long, at long, data binary, asked boolean, crowded boolean")
    contexts = save(contexts, "contexts")
    runs = whole.union(compared(contexts.where("not crowded"), lengths)).union(counted(contexts.where("crowded"), lengths)).distinct()
    runs = runs.groupBy("d1", "d2").agg(F.collect_list(F.when(F.col("unit") == 0, F.col("run"))).alias("runs"), F.collect_list(F.when(F.col("unit") == 1, F.col("run"))).alias("word_runs"))
    runs = save(runs, "runs")
    drop(shared, alike, mixed, equal, have, contexts)
    return runs, some.select("d1", "d2", "data")


def covered(runs: list[int] | None, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal stretches that strings of `length` symbols cover."""
    if not runs:
        return [], []
    a = np.sort(np.array(runs, np.int64))
    low, high = a >> 32, np.maximum.accumulate((a & 0xFFFFFFFF) + length)
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new].tolist(), high[np.concatenate([new[1:], [True]])].tolist()


def removed(data: bytes, runs: list[int] | None, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    starts, ends = covered(runs, length)
    kept = [data[x:y] for x, y in zip([0, *ends], [*starts, len(data)], strict=True)]
    return sum(y - x for x, y in zip(starts, ends, strict=True)), len(starts), b"".join(kept)


def finished(rows: DataFrame, length: int, words: int, with_text: bool) -> DataFrame:
    """What is left of the texts in `rows` (d1, d2, data, runs, word_runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d1, d2, data, own, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, spans, kept = removed(data, own, length)
                passages = sum(y - x for x, y in zip(*covered(said, words), strict=True))
                out.append((d1, d2, n, spans, hashlib.sha256(kept).hexdigest(), passages, kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["d1", "d2", "removed", "spans", "left", "passages", "rest"])

    return rows.select("d1", "d2", "data", "runs", "word_runs").mapInArrow(run, "d1 long, d2 long, removed long, spans long, left string, passages long, rest binary")


def measured(docs: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, d1, d2, n_bytes, n_words, sha and, with `with_text`, the bytes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).cast(pa.binary()).fill_null(b"")
            rows = [(*digest(t), len(t), len(t.split()), hashlib.sha256(t).hexdigest()) for t in data.to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((*[pa.int64()] * 4, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, data if with_text else pa.nulls(len(rows), pa.binary())], names=["doc_id", "d1", "d2", "n_bytes", "n_words", "sha", "data"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, d1 long, d2 long, n_bytes long, n_words long, sha string, data binary")


def strip_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, crowd: int = CROWD, batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept (the bytes left, null without `with_text`)
    of every row. n_passage_words counts the words in passages of `words` words that stand in two places; 0 for
    `words` leaves these out.

    Null text counts as empty; texts shorter than `length` lose nothing. Rows repeated in `docs` are copies of each
    other and lose what is long enough. Null ids stay null. No rows give no rows; other columns are not looked at.
    `length` is between 64 and 500, `words` 0 or between 16 and 500.
    """
    prepare(docs.sparkSession)
    rows = save(measured(docs, with_text), "measured")
    runs, some = repeated_starts(docs, length, words, crowd, batches)
    changed = save(finished(some.join(runs, ["d1", "d2"]), length, words, with_text), "changed")
    drop(some)
    copied = save(rows.groupBy("d1", "d2").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    out = rows.join(copied, ["d1", "d2"], "left").join(changed, ["d1", "d2"], "left")
    # a text with copies repeats as a whole, whatever the index says of its parts
    gone, said = (F.col("copies").isNotNull() & (F.col(c) >= n) for c, n in (("n_bytes", length), ("n_words", words or 1 << 62)))
    nothing = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(said, F.col("n_words")).otherwise(F.coalesce("passages", zero)).alias("n_passage_words"),
        F.when(gone, F.lit(b"")).otherwise(F.coalesce("rest", "data")).alias("kept"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir), with_text=False).drop("kept")
