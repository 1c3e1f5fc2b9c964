"""SimHash near-duplicate groups with a pigeonring candidate filter.

Fingerprints are 64 bits wide. The ring of bits is cut into `segments` segments. If two fingerprints differ in
`budget` bits at most, then from some segment on every chain of consecutive segments stays within its share of the
budget: the first l segments differ in l * budget / segments bits at most. The leading segments whose share is
below one bit must be equal, so they are the join key; the longer chains prune what meets on a key before the
full Hamming distance is looked at.

A key that many fingerprints share is not paired off. Two fingerprints of such a key lie within two bits of each
other exactly if flipping at most one bit of each gives the same word, so each emits its one-bit flips and those
that meet on a word are linked. A word has 65 flips at most, which bounds every group at any size of the input.

Texts that share four fifths of their shingles differ in more bits than a ring can be joined on. A text of up to 250
shingles has the first fifth of them and one more as keys, frequent ones last: two such texts share one for certain,
and the places of the first shared one bound what they can have in common. The shingles of a text of 200 or more fall
by hash into classes of two or three, as many as the text asks for; a class that no edit touched is equal on both
sides, and of the first 40 one is, but for a chance of some 1 in 10^10. Classes of frequent shingles alone are passed
over, or every text with one common passage would meet every other; where half of a text is frequent, its first 40 of all
classes are keys as well, so two such texts meet as before, and with any other text it shares enough of the rest (the
chance to miss is then some 1 in 10^9). What is frequent is counted over all rows, in buckets of their hashes.
Texts that share a key are first compared with two of its texts, of which one has the fewest rarer shingles. Where a key
still holds texts that no link joins, all pairs of a small key are compared. In a crowded one the shingles are counted that no
text of another group holds: of copies with many edits of their own these alone forbid any link. What is left meets the text
with the fewest of them, and then all pairs across the groups are compared. What meets passes a filter on parities before anything wide is looked at: 512 bits of which each shingle
flips one cannot differ in more places than the texts differ in shingles, so it loses no pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import blocks, components, documents, is_empty, prepare, save

#: Words in a shingle, differing bits that still link, segments of the ring, fingerprints paired off on one key.
WORDS, BUDGET, SEGMENTS, PAIRED = 5, 2, 5, 48
SEED = 42
#: Shared part of the shingles that makes two texts similar.
SIMILAR = 0.8
#: Distance above and below the limit within which the part estimated from samples does not decide and all shingles are compared.
UNSURE = (0.15, 0.25)
#: Fewest shingles in a class, classes of a text that are keys, smallest shingle hashes by which two texts are compared.
CLASS, CLASSES, SAMPLE = 2, 40, 128
#: Bits of which each shingle of a text flips one.
PARITIES = 512
#: Texts whose shingle hashes a task remembers while it compares pairs, which come in the order of one side.
REMEMBERED = 256
#: Least shingles of a text that is keyed by classes; one of up to 1 / `SIMILAR` as many is keyed by its rarest shingles.
LONG = 200
#: Bits of the hash by which shingles are counted; of these, bits of a part that is summed by itself; steps of a stored
#: count per doubling.
COUNT_BITS, PART_BITS, STEPS = 22, 16, 16
#: Texts beyond a bucket's share of all shingles from which its shingles are frequent, and at least so many standard deviations.
FREQUENT, DEVIATIONS = 24, 5
#: Frequent part of a text from which classes of frequent shingles are keys too.
COMMON = 0.5
#: Rows of an open key that are paired off at once.
CROWD = 8


def shingle_hashes(data: bytes | None, words: int) -> Iterator[np.ndarray]:
    """Big-endian XXH64 of the shingles of the lower-cased (A-Z) words, repeats included, in blocks; fewer words than
    `words` are one shingle, none are none."""
    hashed, last, some = xxhash.xxh64_digest, [], False
    for part in blocks(data or b""):
        w = last + part.lower().split()
        if len(w) < words:
            last = w
            continue
        digests = b"".join([hashed(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))])
        yield np.frombuffer(digests, np.uint8).reshape(-1, 8)
        some, last = True, w[len(w) - words + 1 :]
    if not some and last:
        yield np.frombuffer(hashed(b" ".join(last), SEED), np.uint8).reshape(1, 8)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The word whose bits are set in over half of the hashes; 0 without any."""
    ones, total = np.zeros(64, np.int64), 0
    for h in hashes:
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """SimHash of a text."""
    return majority(shingle_hashes(data, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array(fps, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ring(segments: int) -> list[int]:
    """Masks of the segments, the highest bits first."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chains(start: int, budget: int, segments: int) -> list[tuple[int, int]]:
    """(mask, most differing bits) for each chain from segment `start` on."""
    masks, mask, out = ring(segments), 0, []
    for n in range(1, segments + 1):
        mask |= masks[(start + n - 1) % segments]
        out.append((mask, n * budget // segments))
    return out


def differing(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(signed(mask))))


def links(fps: DataFrame, budget: int = BUDGET, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints of `fps` (fp) within `budget` bits, directly or by a third.

    `budget` is 2: the bounded way through crowded keys rests on single flips of both sides.
    """
    if budget != 2:
        raise ValueError("budget is 2")
    rules = [chains(i, budget, segments) for i in range(segments)]
    exact = [[m for m, most in r if most == 0][-1] for r in rules]
    keys = save(fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in exact])).alias("seg", "key")), "keys")
    counts = keys.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(keys.join(counts, ["seg", "key"]), "shared")
    few = shared.where(F.col("n") <= paired)
    x = F.col("fp").bitwiseXOR(F.col("other"))
    within = F.lit(False)
    for i, r in enumerate(rules):
        ok = F.col("seg") == i
        for mask, most in r:
            if most:
                ok = ok & (differing(x, mask) <= most)
        within = within | ok
    pairs = few.select("seg", "key", "fp").join(few.select("seg", "key", F.col("fp").alias("other")), ["seg", "key"])
    pairs = pairs.where(F.col("fp") < F.col("other")).where(within).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    flips = F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << k)) for k in range(64) if not m >> k & 1]).cast("array<bigint>") for m in exact])
    many = shared.where(F.col("n") > paired).select("fp", F.explode(F.element_at(flips, F.col("seg") + 1)).alias("flip"))
    many = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).distinct()
    least = many.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    met = many.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(met).distinct()


def near_groups(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (signed long), component_id (smallest doc_id that links reach).

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id keeps its row and never names a
    group; a group without any id has a null component_id. Repeated rows fall into one group. No rows give no rows.
    """
    fps = save(fingerprints(docs, words), "fps")
    distinct = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct.select("fp"), budget, segments))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = save(named, "named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "label").select("fp", "component_id"), "fp")


def class_keys(distinct: np.ndarray, similar: float = SIMILAR, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of the first classes of sorted distinct shingle hashes, for each number of classes that a similar text may have.
    Classes of `frequent` shingles alone (a flag per bucket) are passed over, or added where most of the text is frequent."""
    n, out = len(distinct), []
    if n < LONG:
        return np.empty(0, np.uint64)
    often = frequent[bucket_of(distinct)] if frequent is not None else np.zeros(n, bool)
    common = often.mean() > COMMON
    low, high = (math.floor(2 * math.log2(x / CLASS) + e) for x, e in ((n, -1e-9), (n / similar, 1e-9)))
    for level in range(low, high + 1):
        c = int(2 ** (level / 2))
        every = ((distinct >> np.uint64(32)) * np.uint64(c) >> np.uint64(32)).astype(np.int64)
        reach = CLASSES
        while True:
            place = every[: np.searchsorted(every, reach)]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            passed = np.logical_and.reduceat(often[: len(place)], starts) if len(place) else np.empty(0, bool)
            if reach >= c or reach - passed.sum() >= CLASSES:
                break
            reach = min(c, 2 * reach)
        if not len(place):
            continue
        at = place[starts]
        kept = ~passed & (at - np.cumsum(passed) < CLASSES) | common & (at < CLASSES)
        sums = np.add.reduceat(distinct[: len(place)], starts)
        out.append(((sums ^ (np.uint64(c) << np.uint64(32) | at.astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15))[kept])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def prefix_size(n: int, similar: float = SIMILAR) -> int:
    """Shingles of a text of n that are keys, so that every similar text shares one; 0 for a text keyed by classes alone."""
    return n - math.ceil(similar * n - 1e-9) + 1 if 0 < n <= LONG / similar else 0


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def prefix_keys(distinct: np.ndarray, frequent: np.ndarray | tuple[np.ndarray, np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """The first of sorted distinct shingle hashes, by count (`frequent`: of every bucket, or sorted buckets and their counts)
    and then by hash."""
    size = prefix_size(len(distinct), similar)
    bucket = bucket_of(distinct)
    if isinstance(frequent, np.ndarray):
        return distinct[np.argsort(frequent[bucket], kind="stable")[:size]]
    if not size or not len(frequent[0]):
        return distinct[:size]
    at = np.minimum(np.searchsorted(frequent[0], bucket), len(frequent[0]) - 1)
    count = np.where(frequent[0][at] == bucket, frequent[1][at], 0)
    return distinct[np.argsort(count, kind="stable")[:size]]


def counted(docs: DataFrame, words: int, similar: float = SIMILAR) -> DataFrame:
    """part, total, counts: of every part of the buckets the texts that hold each bucket's shingles, one byte a bucket in
    steps of `STEPS` per doubling; first of the texts that are keyed by shingles, then of those keyed by classes.

    A task counts its own rows, whatever it reads, and passes on one packed row per part.
    """
    size = 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, 1 << COUNT_BITS), np.uint32)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                distinct = distinct_hashes(t, words).astype(np.uint64)
                held, n = np.unique(bucket_of(distinct), return_counts=True)
                for kind, asked in enumerate((prefix_size(len(distinct), similar), len(distinct) >= LONG)):
                    if asked:
                        own[kind, held] += n.astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1)
        rows = own.reshape(-1, size)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([squeeze.compress(rows[k].tobytes()) for k in some], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        opened = zstandard.ZstdDecompressor()
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(size, np.int64))
                sums[part] += np.frombuffer(opened.decompress(packed), np.uint32)
        codes = [stepped(x).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([int(x.sum()) for x in sums.values()], pa.int64()), pa.array(codes, pa.binary())], names=["part", "total", "counts"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(count, "part long, counts binary")
    return each.repartition("part").mapInArrow(add, "part long, total long, counts binary")


def stepped(counts: np.ndarray | float) -> np.ndarray:
    return np.minimum(255, STEPS * np.log2(np.asarray(counts) + 1.0)).astype(np.uint8)


def frequent_shingles(docs: DataFrame, words: int, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets, in steps, over the texts that are keyed by shingles, and whether a bucket is frequent in those
    keyed by classes. All rows count; what comes to the driver has one size for any input."""
    codes, total = np.zeros((2, 1 << COUNT_BITS), np.uint8), 0
    parts = codes.reshape(-1, 1 << PART_BITS)
    for r in counted(docs, words, similar).collect():
        parts[r.part] = np.frombuffer(r.counts, np.uint8)
        total += r.total if r.part >= len(parts) // 2 else 0
    mean = total / codes.shape[1]
    return codes[0], codes[1] > stepped(mean + max(FREQUENT, DEVIATIONS * math.sqrt(mean)))


def sketches(docs: DataFrame, words: int, similar: float = SIMILAR) -> DataFrame:
    """row (a number of its own), doc_id, fp, n (distinct shingles), keys (of shingles, then of classes), sample (smallest hashes), bits (parities
    of the shingles, in longs), data (the text) of every row."""
    prepare(docs.sparkSession)
    counts, frequent = frequent_shingles(docs, words, similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).cast(pa.binary()).to_pylist():
                parts = list(shingle_hashes(t, words))
                distinct = np.unique(np.concatenate(parts).view(">u8").ravel()).astype(np.uint64) if parts else np.empty(0, np.uint64)
                keys = np.concatenate([prefix_keys(distinct, counts, similar), class_keys(distinct, similar, frequent)])
                for c, v in zip(cols, (row, majority(iter(parts)), len(distinct), keys.view(np.int64), distinct[:SAMPLE].tobytes(), parities(distinct)), strict=True):
                    c.append(v)
                row += 1
            fps = pa.array(np.array(cols[1], np.uint64).view(np.int64))
            arrays = [pa.array(cols[0], pa.int64()), b.column(0), fps, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.int64())), b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "fp", "n", "keys", "sample", "bits", "data"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "row long, doc_id long, fp long, n long, keys array<bigint>, sample binary, bits array<bigint>, data binary")


def parities(distinct: np.ndarray) -> np.ndarray:
    """`PARITIES` bits, as longs, of which each of the hashes flips one."""
    odd = np.bincount((distinct % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def padded(samples: list[bytes]) -> np.ndarray:
    """Samples as rows of `SAMPLE` hashes, short ones filled up with the largest number."""
    out = np.full((len(samples), SAMPLE), np.iinfo(np.uint64).max, np.uint64)
    for row, x in zip(out, samples, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, np.uint64)
    return out


def shared_parts(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaccard similarities from the smallest hashes of pairs of texts: exact if both have `SAMPLE` shingles at most."""
    x, y = padded(a), padded(b)
    none = np.iinfo(np.uint64).max
    both = np.sort(np.hstack([x, y]), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    rank = np.cumsum(~again & (both != none), axis=1)
    size = rank[:, -1]
    full = (x[:, -1] != none) | (y[:, -1] != none)
    upto = np.where(full, np.minimum(size, SAMPLE), size)
    return (again & (rank <= upto[:, None])).sum(axis=1) / np.maximum(upto, 1)


def distinct_hashes(data: bytes | None, words: int) -> np.ndarray:
    parts = list(shingle_hashes(data, words))
    return np.unique(np.concatenate(parts).view(">u8").ravel()) if parts else np.empty(0, ">u8")


def class_rows(own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """row, n, key, shingle (or a class), place (of a shingle in the order of its text, 0 for a class) of every key of `own`
    (as `sketches`)."""
    shingle = (F.col("n") <= LONG / similar) & (F.col("place") <= F.col("n") - F.ceil(similar * F.col("n") - 1e-9))
    keys = own.select("row", "n", F.posexplode("keys").alias("place", "key"))
    return keys.select("row", "n", "key", shingle.alias("shingle"), F.when(shingle, F.col("place")).otherwise(0).alias("place"))


def end_pairs(own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of each row with the first and last row of its keys, of fitting sizes.

    First is the row with the fewest shingles that are rarer than the key: of the copies of one text it is the one with the
    fewest edits, so all that are similar to another by that key are similar to it, or nearly.
    """
    keys = class_rows(own, similar)
    ends = keys.groupBy("key").agg(F.min(F.struct("place", "row", "n")).alias("low"), F.max(F.struct("row", "n")).alias("high"), F.count("*").alias("rows")).where("rows > 1")
    ends = ends.select("key", F.struct("low.row", "low.n").alias("low"), "high")
    met = keys.join(ends, "key").select("row", "n", F.explode(F.array("low", "high")).alias("other")).where("row <> other.row")
    met = met.where(F.least("n", "other.n") >= similar * F.greatest("n", "other.n") - 1e-9)
    return met.select(F.least("row", "other.row").alias("a"), F.greatest("row", "other.row").alias("b")).distinct()


def open_rows(keys: DataFrame) -> DataFrame:
    """Those of `keys` (key, label) whose key stands in rows of two labels."""
    left = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return keys.join(left, "key")


def fitting(one: str, two: str, similar: float, *bounds: str) -> Column:
    """Whether rows of the aliases `one` and `two` may be similar by the shingles that each may share at most (`bounds`)."""
    most = F.least(*[F.expr(bound.format(side)) for side in (one, two) for bound in bounds])
    return most >= similar / (1 + similar) * (F.col(f"{one}.n") + F.col(f"{two}.n")) - 1e-6


def met_on_keys(rows: DataFrame, similar: float, *bounds: str) -> DataFrame:
    """Pairs (a, b) of rows of two labels that share a key and fit by `bounds`."""
    a, b = rows.alias("a"), rows.alias("b")
    # texts that both have shingles for keys need no class to meet
    asked = F.col("a.shingle") | (F.greatest("a.n", "b.n") > LONG / similar)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.label") != F.col("b.label")) & fitting("a", "b", similar, *bounds) & asked)
    return pairs.select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct()


def shingles_of(own: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """row, shingle of all distinct shingles of the texts in `rows` (row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [distinct_hashes(t, words).astype(np.uint64).view(np.int64) for t in b.column(1).to_pylist()]
            row = np.repeat(b.column(0).to_numpy(), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.concatenate(hashes), pa.int64())], names=["row", "shingle"])

    asked = save(rows.select("row").distinct(), "asked")
    return own.select("row", "data").join(asked, "row", "left_semi").mapInArrow(run, "row long, shingle long")


def with_common(rows: DataFrame, shingles: DataFrame, similar: float) -> DataFrame:
    """Those of the open `rows` (as `class_rows`, with label) that may be similar to a row of another label, with `common`: the
    shingles of the row that rows of other labels hold as well, of which it can share no more with any of them."""
    each = shingles.join(rows.select("row", "label").distinct(), "row")
    shared = each.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    common = each.join(shared, "shingle", "left_semi").groupBy("row").agg(F.count("*").alias("common"))
    rows = rows.join(common, "row").where(F.col("common") >= similar * F.col("n") - 1e-9)
    return save(open_rows(save(rows, "common")), "open")


def open_pairs(own: DataFrame, labels: DataFrame, similar: float = SIMILAR, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of rows that share a key, of fitting sizes: all that may be similar, but for those that links of `labels` (node,
    label) and of pairs returned here join already.

    Keys of up to `crowd` rows are paired off. In crowded ones a row is left out if so many of its shingles stand in no row of
    another label that it can be similar to none; each key's row with the fewest such shingles meets the others, which joins
    most of what is similar, and what is left is paired off.
    """
    keys = class_rows(own, similar).join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    rows = save(open_rows(save(keys, "labelled")), "open")
    counts = save(rows.groupBy("key").agg((F.count("*") > crowd).alias("many")), "counts")
    rows = save(rows.join(counts, "key"), "open")
    # what stands before the first shared shingle is not shared
    place = "{0}.n - {0}.place"
    few, many = met_on_keys(rows.where("not many"), similar, place), rows.where("many")
    if is_empty(many):
        return few
    shingles = save(shingles_of(own, many, words), "shingles")
    many = with_common(many, shingles, similar)
    heads = many.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("alone"), "row", "label", "n", "common")).alias("h")).select("key", "h.*")
    met = many.alias("a").join(heads.alias("b"), "key").where(F.col("a.label") != F.col("b.label")).where(fitting("a", "b", similar, "{0}.common"))
    met = met.select(F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b")).distinct()
    led = save(similar_links(own, met, words, similar), "led")
    of = save(many.select("row", "label").distinct(), "labels")
    for side in "ab":
        of_side = of.select(F.col("row").alias(side), F.col("label").alias(f"{side}_"))
        led_by = (led if side == "a" else led_by).join(of_side, side)
    joined = components(led_by.select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    many = many.drop("common").join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    many = many.withColumn("label", F.coalesce("least", "label")).drop("least")
    many = with_common(save(open_rows(save(many, "labelled")), "open"), shingles, similar)
    return few.union(led).union(met_on_keys(many, similar, place, "{0}.common")).distinct()


def possible(own: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of `pairs` (a, b) of rows of `own` (as `sketches`) whose parities allow the similarity."""
    x = own.select(F.col("row").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ax"))
    y = own.select(F.col("row").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bx"))
    apart = functools.reduce(Column.__add__, [F.bit_count(F.get("ax", F.lit(i)).bitwiseXOR(F.get("bx", F.lit(i)))) for i in range(PARITIES // 64)])
    most = (1 - similar) / (1 + similar) * (F.col("an") + F.col("bn")) + 1e-6
    return pairs.join(x, "a").join(y, "b").where(apart <= most).select("a", "b")


def similar_links(own: DataFrame, close: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Those of the pairs `close` (a, b) of rows of `own` (as `sketches`) that have the similarity."""
    close = save(possible(own, close, similar), "close")

    def beside(pairs: DataFrame, name: str) -> DataFrame:
        # one pass over the wide column brings out the rows that pairs ask for; both sides then read those alone;
        # the hint keeps one plan for every size
        asked = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        wide = save(own.select("row", "n", name).join(asked.hint("merge"), "row", "left_semi"), "wide")
        a = wide.select(F.col("row").alias("a"), F.col("n").alias("an"), F.col(name).alias("ax"))
        return pairs.join(a, "a").join(wide.select(F.col("row").alias("b"), F.col("n").alias("bn"), F.col(name).alias("bx")), "b").select("a", "b", "an", "bn", "ax", "bx")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = shared_parts(b.column(4).to_pylist(), b.column(5).to_pylist())
            most = np.maximum(b.column(2).to_numpy(), b.column(3).to_numpy())
            sure = (most <= SAMPLE) | (part > similar + UNSURE[0]) | (part < similar - UNSURE[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure), pa.array(part + 1e-9 >= similar)], names=["a", "b", "sure", "yes"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = functools.lru_cache(REMEMBERED)(lambda data: distinct_hashes(data, words))
        for b in batches:
            yes = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                one, two = hashes(x), hashes(y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                yes.append(both + 1e-9 >= similar * (len(one) + len(two) - both))
            yield b.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    told = save(beside(close, "sample").mapInArrow(estimate, "a long, b long, sure boolean, yes boolean"), "told")
    more = beside(told.where("not sure").select("a", "b"), "data").mapInArrow(exact, "a long, b long")
    return told.where("sure and yes").select("a", "b").union(more)


def similar_groups(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, similar: float = SIMILAR) -> DataFrame:
    """One row per row of `docs`: doc_id, component_id (smallest doc_id of its group, null where none has one).

    Rows are linked if their fingerprints lie within `budget` bits, or if they share `similar` of their shingles. Texts
    without words are one group. Repeated rows fall into one group, nulls count as empty, no rows give no rows.
    """
    own = save(sketches(docs, words, similar), "sketches")
    reps = save(own.groupBy("fp").agg(F.min("row").alias("rep")), "reps")
    alike = own.join(reps, "fp").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    near = links(reps.select("fp"), budget)
    for side in "ab":
        near = near.join(reps.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_")), side).drop(side).withColumnRenamed(f"{side}_", side)
    labels = components(alike.union(near.select("a", "b")).union(similar_links(own, end_pairs(own, similar), words, similar)))
    more = similar_links(own, open_pairs(own, labels, similar, words), words, similar)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    named = save(own.select("row", "doc_id").join(labels.withColumnRenamed("node", "row"), "row", "left").select("doc_id", F.coalesce("label", "row").alias("label")), "named")
    least = save(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "label").select("doc_id", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, words: int = WORDS, budget: int = BUDGET, similar: float = SIMILAR) -> DataFrame:
    """Rows of `docs`, of each group of near duplicates the one with the smallest doc_id.

    Rows without a doc_id stay, as nothing says which of them a group would keep; of a repeated doc_id all rows stay
    unless one of them is in a group that another document leads. Which pairs are found is said at the head of the
    module: all within the bits, all of up to `LONG` / `similar` shingles that are similar, and longer ones but for the
    chance that no class is shared; pairs that samples put far from the limit are not compared on all shingles.
    """
    groups = similar_groups(docs.select("doc_id", "text"), words, budget, similar)
    go = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex), component_id by 3-word shingles, linked within 2 bits."""
    groups = near_groups(documents(spark, sf_dir), words=3, budget=2)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", hexed.alias("fingerprint"), "component_id")
