"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents are encoded where they lie and leave as pieces (lengths and checksums). Pieces of more than half a sequence
open one each and leave its gap. The rest follow in classes of falling length. A round of a class sorts gaps and pieces
into ranges by size, and a sweep from the largest size down gives every piece its successor, the smallest gap not yet
taken that holds it: gaps go on a stack, a piece takes the top. A sweep within a range leaves pieces without a gap and
gaps without a piece; counts of these per range are carried over the ranges, and by them each such piece finds the gap
of an earlier range at its depth of the stack. So claims on one gap cannot arise but by rank, in the order of the
ranges. Gaps are updated, and the next round takes the pieces that are left, until the class is placed. A gap that holds
several of the longest pieces of the class is that many gaps in a round. New sequences open where the free tokens cannot
hold all pieces still to come, and where a round places nothing. Rounds are written to the shared folder; the driver sees
a few totals of each.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, drop, prepare, save

CAPACITY, END_ID = 2048, 0
#: Shares of a sequence at which the classes of pieces end.
CLASSES = (1 / 2, 1 / 3, 1 / 4, 1 / 6, 1 / 8, 1 / 16, 1 / 32, 1 / 128)
#: Rows of a range of a sweep: fewer are one range, so small rounds are not cut into many tasks.
RANGE_ROWS = 1 << 17
#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000
#: Characters of a text that are split into words at once.
STRIDE = 1 << 20
#: Punctuation that is cut off a word before it is looked up.
TRAILING = ".,;:!?|*#%$&"

ENCODERS: dict[str, Encoder] = {}


def byte_symbols() -> str:
    """The 256 characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Encoder(dict):
    """Ids of texts under a tokenizer file. If it drops white space and splits words, each word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # the parts' own JSON, not the file's, which holds the whole vocabulary
        parts, lower = (x.__getstate__().decode() if x else "{}" for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        first = next(iter(json.loads(parts).get("pretokenizers", [{}])))
        self.by_word = (
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in json.dumps(first).replace("\\\\", "\\")
            and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
            and '"Lowercase"' in lower
        )
        self.model, self.symbols = self.tokenizer.model, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        stem = word.rstrip(TRAILING)
        # a capital whose lower case ends in a mark, as of I with a dot, stands with the punctuation after it
        if stem and len(stem) < len(word) and (stem if stem.isascii() else unicodedata.normalize("NFC", stem)).lower()[-1].isalpha():
            ids = self[stem] + self[word[len(stem) :]]
        elif word.isascii() and word.isalpha():
            # letters of ASCII are their own normal form and symbols
            found = [t.id for t in self.model.tokenize(word.lower())]
            ids = struct.pack(f"<{len(found)}I", *found)
        elif word.isalpha() and not ("İ" in word or "Σ" in word):
            low = unicodedata.normalize("NFC", word).lower().encode()
            found = [t.id for t in self.model.tokenize("".join(map(self.symbols.__getitem__, low)))]
            ids = struct.pack(f"<{len(found)}I", *found)
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, start = [], 0
        while start < len(text):
            end = len(text) if start + STRIDE >= len(text) else text.find(" ", start + STRIDE)
            end = len(text) if end < 0 else end
            out.append(b"".join(map(self.__getitem__, text[start:end].replace("\n", " ").split(" "))))
            start = end
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and row, a number of its own.

    Null text counts as empty and gives one piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(own.ids(text or "") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row), strict=True):
                        c.append(v)
                    row += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


#: Kinds of rows of a sweep: a gap or a piece that its range leaves over, and a match.
GAP, PIECE, MATCH = 0, 1, 2
SWEPT = "part int, kind int, turn long, row long, length long, sequence_id long"


def sweep(gaps: DataFrame, pieces: DataFrame, longest: int, ranges: int) -> DataFrame:
    """Matches and leftovers of each of `ranges` ranges of sizes. `gaps` has sequence_id, gap; `pieces` row, length up to
    `longest`.

    turn numbers the leftovers of a range by kind, in the order of the sweep.
    """
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
    one = gaps.select(F.least("gap", F.lit(longest)).alias("size"), F.lit(GAP).alias("kind"), F.col("gap"), F.col("sequence_id").alias("id"), F.explode(F.sequence(F.lit(1), slots)).alias("slot"))
    two = pieces.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), F.lit(0).cast("long").alias("gap"), F.col("row").alias("id"), F.lit(0).alias("slot"))
    order = [F.desc("size"), F.col("kind"), F.desc("gap"), F.col("id"), F.col("slot")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, alone = TaskContext.get().partitionId(), [], 0

        def rows(of: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in of], k) for i, k in enumerate(kinds)], names=["part", "kind", "turn", "row", "length", "sequence_id"])

        for b in batches:
            out = []
            for size, kind, _, key, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == GAP:
                    stack.append(key)
                elif stack:
                    out.append((part, MATCH, 0, key, size, stack.pop()))
                else:
                    out.append((part, PIECE, alone, key, size, None))
                    alone += 1
            yield rows(out)
        yield rows([(part, GAP, k, None, None, key) for k, key in enumerate(stack)])

    both = one.union(two)
    both = both.coalesce(1) if ranges == 1 else both.repartitionByRange(ranges, *order)
    return both.sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def settled(swept: DataFrame, ranges: int) -> DataFrame:
    """row, length, sequence_id of all pieces of a sweep; no sequence where no gap was left."""
    if ranges == 1:
        return swept.where(F.col("kind") != GAP).select("row", "length", "sequence_id")
    left = swept.where(F.col("kind") != MATCH)
    # two counts per range, whatever the size of the input: the gaps on the stack before and after a range's pieces
    sums = left.groupBy("part").agg(F.count_if(F.col("kind") == PIECE).alias("pops"), F.count_if(F.col("kind") == GAP).alias("pushes"))
    carried, top = [], 0
    for r in sorted(sums.collect()):
        base = max(0, top - r["pops"])
        carried.append((r["part"], top, base))
        top = base + r["pushes"]
    tops, bases = ([F.lit(x) for r in carried for x in (r[0], r[k])] for k in (1, 2))
    look = lambda pairs: F.try_element_at(F.create_map(*pairs), F.col("part")).cast("long")
    depth = F.when(F.col("kind") == PIECE, look(tops) - F.col("turn")).otherwise(look(bases) + 1 + F.col("turn")) if carried else F.lit(0)
    left = left.withColumn("depth", depth).select("part", "kind", "row", "length", "sequence_id", "depth")
    # at one depth a gap is followed by the piece that takes it; a depth has two rows per range at most
    before = F.lag("sequence_id").over(Window.partitionBy("depth").orderBy("part", F.desc("kind")))
    met = left.where("depth > 0").withColumn("taken", before).where(F.col("kind") == PIECE).select("row", "length", F.col("taken").alias("sequence_id"))
    none = left.where((F.col("depth") <= 0) & (F.col("kind") == PIECE)).select("row", "length", F.lit(None).cast("long").alias("sequence_id"))
    return swept.where(F.col("kind") == MATCH).select("row", "length", "sequence_id").union(met).union(none)


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """row, sequence_id, offset of every one of `pieces` (row, length up to `capacity`), a saved table.

    Sequences opened by a long piece have its row for a number, others negative numbers.
    """
    spark = pieces.sparkSession
    bounds = [int(capacity * x) for x in CLASSES if capacity * x >= 1] + [0]
    free = F.lit(capacity) - F.col("length")
    big = pieces.where(F.col("length") > bounds[0])
    gaps = save(big.where(free > 0).select(F.col("row").alias("sequence_id"), free.alias("gap")), "gaps")
    band = F.lit(0)
    for x in bounds[:-1]:
        band = band + (F.col("length") <= x).cast("int")
    sums = {r["band"]: r for r in pieces.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.sum(free).alias("free")).collect()}
    room, waiting = sums[0]["free"] if 0 in sums else 0, sum(r["tokens"] for k, r in sums.items() if k)
    done, opened = [], 0
    for k, (longest, shorter) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        if k not in sums:
            continue
        rest, n, tokens = pieces.where((F.col("length") <= longest) & (F.col("length") > shorter)).select("row", "length"), sums[k]["n"], sums[k]["tokens"]
        stuck = False
        while n:
            new = max(-(-(waiting - room) // capacity), -(-tokens // capacity) if stuck else 0, 0)
            if new:
                fresh = spark.range(opened, opened + new).select((-1 - F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened, room = gaps.union(fresh), opened + new, room + new * capacity
            # at most: pieces, gaps, and the slots of gaps beyond one each
            rows = n + (sums[0]["n"] if 0 in sums else 0) + opened + room // longest
            ranges = -(-rows // RANGE_ROWS)
            swept = save(sweep(gaps.where(F.col("gap") > shorter), rest, longest, ranges), "swept")
            got = settled(swept, ranges)
            both = gaps.select("sequence_id", "gap", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("length"))
            both = both.union(got.where("sequence_id is not null").select("sequence_id", F.lit(None).cast("long"), "row", "length"))
            both = both.coalesce(1) if ranges == 1 else both
            of = Window.partitionBy("sequence_id")
            before = F.sum("length").over(of.orderBy(F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
            whole, took = F.max("gap").over(of), F.coalesce(F.sum("length").over(of), F.lit(0))
            both = both.select("row", "length", "sequence_id", (F.lit(capacity) - whole + F.coalesce(before, F.lit(0))).alias("offset"), (whole - took).alias("gap"))
            seen = Observation()
            both = both.observe(seen, F.count("row").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
            state = save(both.union(got.where("sequence_id is null").select("row", "length", "sequence_id", F.lit(None).cast("long"), F.lit(None).cast("long"))), "round")
            now, moved = state.where("row is not null and sequence_id is not null"), seen.get
            drop(swept)
            n, tokens, room, waiting, stuck = n - moved["n"], tokens - moved["tokens"], room - moved["tokens"], waiting - moved["tokens"], not moved["n"]
            done.append(now.select("row", "sequence_id", "offset"))
            gaps = state.where("row is null and gap > 0").select("sequence_id", "gap")
            rest = state.where("sequence_id is null").select("row", "length")
    out = big.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for now in done:
        out = out.union(now)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than `capacity` are cut. Rows repeated in `docs` are packed each for itself; null ids stay
    null. No rows give no rows; columns other than doc_id and text are not looked at.
    """
    own = save(pieces(docs, tokenizer, capacity, end_id), "pieces")
    out = own.join(placed(own.select("row", "length"), capacity), "row")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_tokenizer())
