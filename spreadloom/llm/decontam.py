"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts and test items are compared in lower case, with every run of other than letters and digits as one space, and a
space before and after: an item is looked for as whole words, and a stretch that begins or ends within a word pays for
it in edits. An item of m characters may differ in `m * RATE` edits from a stretch of a document; one of fewer than
1 / `RATE` characters has to stand as it is. It is split into one piece more than its edits, so a stretch within the
budget holds one piece unchanged; an automaton finds the pieces, and Myers' bit-parallel distance decides around each hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, prepare

#: Edits for each character of an item.
RATE = 0.08
#: Characters of items that go to the executors at once; more items take more passes.
BLOCK = 4_000_000

APART = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return APART.sub(" ", (text or "").lower()).strip()


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of `budget` + 1 pieces of nearly equal length."""
    at = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of `item` to a stretch of `text`, and the first end of such a stretch."""
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        if score < best[0]:
            best = (score, end)
    return best


class Searcher:
    """Finds items [(item_id, normalised text)] in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, f" {t} ", int(len(t) * rate)) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, budget) in enumerate(self.items):
            for offset, piece in split(t, budget):
                pieces[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, first end of the item's last word) for each item within its budget."""
        text = f" {text} "
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (n, places) in self.automaton.iter(text):
            for k, offset in places:
                starts[k].add(last + 1 - n - offset)
        out = []
        for k, found in starts.items():
            item_id, item, budget = self.items[k]
            exact = [s for s in found if s >= 0 and text.startswith(item, s)]
            if exact:
                out.append((item_id, 0, min(exact) + len(item) - 2))
                continue
            best, low, high = (budget + 1, 0), None, None
            for s in [*sorted(found), None]:
                if low is not None and (s is None or s - 2 * budget > high):
                    a = max(0, low - budget)
                    score, end = myers(item, text[a : high + len(item) + budget])
                    best = min(best, (score, a + end))
                    low = None
                if low is None:
                    low = s
                high = s
            if best[0] <= budget:
                out.append((item_id, best[0], max(0, best[1] - 2)))
        return out


def blocks_of(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items that have letters or digits, `size` characters at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        if block and n + len(t) > size:
            yield block
            block, n = [], 0
        block.append((r["item_id"], t))
        n += len(t)
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_size: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, ends_at (in the normalised text) of each row of `docs` and each item within its budget.

    Null and empty texts and items match nothing, nor do items without an id; an item id given twice is searched by
    each of its texts and reported once for each. Of several places with the least distance the first end counts. Texts
    of any length are searched whole, one in memory at a time. Repeated rows of `docs` are reported each; columns other
    than doc_id and text are not looked at; no rows give no rows. The items pass the driver in blocks of at most
    `block_size` characters, and `docs` is read once a block.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, ends_at long")
    for block in blocks_of(benchmark, block_size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = Searcher(shared.value, rate)
            for b in batches:
                got = [(d, *v) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for v in s.find(normal(t))]
                cols = list(zip(*got, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "ends_at"])

        out = out.union(rows.mapInArrow(run, out.schema))
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_size: int = BLOCK) -> DataFrame:
    """Rows of `docs` in which no item is found, with all columns.

    Null and empty texts hold no item and stay, repeated rows stay or go alike, no rows give no rows, and an empty
    benchmark keeps all.
    """
    prepare(spark)
    place = docs.columns.index("text")
    for block in blocks_of(benchmark, block_size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = Searcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not s.find(normal(t)) for t in b.column(place).cast(pa.string()).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
