"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased, UTF-8) is cut where a rolling hash of its last 32 bytes has its highest bits clear, so equal
stretches are cut alike. The chunks of all texts are deduplicated once, by identifier and SHA-256 of the content
together; an identifier that two contents share shows there, and then a stronger one is taken for all chunks. After
that a text is the ordered list of its chunk identifiers, its recipe, and only recipes are grouped and joined: the
documents themselves never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, is_empty, prepare, save

#: Bits that are clear at a cut (a chunk has 2**CUT_BITS bytes on average), and the longest chunk.
CUT_BITS, LONGEST = 11, 1 << 15
#: Bytes that the rolling hash sees.
SEEN = 32
#: Bytes hashed at once.
STRIDE = 1 << 22

GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def short_id(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def long_id(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=32).digest()


#: Identifiers in the order in which they are tried.
IDENTIFIERS: tuple[Callable[[bytes], bytes], ...] = (short_id, long_id)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text."""
    found = []
    for at in range(0, len(data), STRIDE):
        low = max(0, at - SEEN + 1)
        h = GEAR[data[low : at + STRIDE]]
        for s in (1, 2, 4, 8, 16):
            h[s:] += h[:-s] << np.uint32(s)
        ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + low
        found.append(ends[(ends >= at) & (ends >= SEEN - 1)] + 1)
    ends = np.concatenate([*found, [len(data)]]) if len(data) else np.empty(0, np.int64)
    ends = np.unique(ends)
    gaps = np.diff(ends, prepend=0)
    if len(ends) and gaps.max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(e - g + LONGEST, e, LONGEST), e) for e, g in zip(ends, gaps, strict=True)])
    return ends


def chunked(data: bytes | None) -> tuple[bytes, list[bytes]]:
    """The normalised text and its chunks."""
    a = LOWER[np.frombuffer(data or b"", np.uint8)]
    text, start, out = a.tobytes(), 0, []
    for end in cuts(a).tolist():
        out.append(text[start:end])
        start = end
    return text, out


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(docs: DataFrame, identify: Callable[[bytes], bytes]) -> DataFrame:
    """id and witness (SHA-256 of the content) of every chunk of every text, each once for each batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {c for t in texts_of(b.column(0)) for c in chunked(t)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([identify(c) for c in seen], pa.binary()), pa.array([hashlib.sha256(c).digest() for c in seen], pa.binary())], names=["id", "witness"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "id binary, witness binary")


def recipes(docs: DataFrame, identify: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, recipe (identifiers in order) and sha256 (hex, of the normalised text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [chunked(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([
                b.column(0),
                pa.array([b"".join(map(identify, c)) for _, c in both], pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t, _ in both], pa.string()),
            ], names=["doc_id", "recipe", "sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, recipe binary, sha256 string")


def verified(docs: DataFrame, identifiers: tuple[Callable[[bytes], bytes], ...] = IDENTIFIERS) -> Callable[[bytes], bytes]:
    """The first identifier under which no two chunk contents of `docs` are called the same, as their SHA-256 tells."""
    for identify in identifiers:
        once = chunks(docs, identify).distinct()
        shared = once.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        if is_empty(shared):
            return identify
    raise ValueError("every identifier names two chunks alike")


def duplicate_groups(docs: DataFrame, identifiers: tuple[Callable[[bytes], bytes], ...] = IDENTIFIERS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Of equal texts the largest doc_id stays; of rows that
    repeat both doc_id and text one is kept. Null ids lose to any id; a group without any id keeps one of its rows
    and has a null keep_id. No rows give no rows; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    own = save(recipes(docs, verified(docs, identifiers)), "recipes")
    rows = own.groupBy("recipe", "sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = save(own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("sha256").alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("turn"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def with_sha256(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the hex digest of each normalised text."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256((t or b"").lower()).hexdigest() for t in texts_of(b.column(place))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit("")).schema)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of `docs`, of each group of equal texts the one that `duplicate_groups` keeps, with all its columns."""
    groups = duplicate_groups(docs.select("doc_id", "text"))
    mark = "sha256_" + "_".join(c for c in docs.columns if c.startswith("sha256_"))
    counts = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    counts = save(counts.select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), "n"), "kept")
    tagged = with_sha256(docs, mark)

    def chosen(some: DataFrame) -> DataFrame:
        return tagged.join(some, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col(mark) == F.col("k_sha")), "left_semi")

    out = chosen(counts.where("n = 1")).select(*docs.columns)
    again = counts.where("n > 1")
    if is_empty(again):
        return out
    return out.unionByName(chosen(again).dropDuplicates(["doc_id", mark]).select(*docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
