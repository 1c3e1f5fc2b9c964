"""Secret scans: fixed patterns, and Markov models of random strings against ordinary text.

Two character models of order one are trained on the table itself: one on what the fixed patterns label as secrets,
one on every other run of identifier characters. A run of sixteen characters or more is a secret too if the first
model finds it likelier by `MARGIN` nats or more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, prepare

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Words of which an assignment has one; their search is faster than the pattern's.
WORDS = ("passw", "secret", "token", "api")
VALUE = 12

#: Characters of a run; index 0 stands for all others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIDE = len(ALPHABET) + 1
CODE = np.zeros(256, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIDE)
#: Share of the random model that is uniform, so that it covers alphabets that no label shows.
UNIFORM = 0.3
#: Transitions that the single characters' shares are worth where a model has seen few.
BACK = 1000.0
#: Nats by which a run must be likelier as a random string.
MARGIN = 20.0

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def steps(text: str) -> np.ndarray:
    """Cell of every transition between characters of runs."""
    c = CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    return (c[:-1] * SIDE + c[1:])[(c[:-1] > 0) & (c[1:] > 0)] if len(c) > 1 else np.empty(0, np.int64)


def transitions(docs: DataFrame) -> DataFrame:
    """cell, random, ordinary: counts of transitions within labelled secrets and within all other runs, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIDE * SIDE), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                rest, at = [], 0
                for start, kind, end in base_spans(text or ""):
                    value = text[start:end]
                    value = ASSIGN.match(value)[2] if kind == 0 else value
                    counts[0] += np.bincount(steps(value), minlength=SIDE * SIDE)
                    rest.append(text[at : max(at, start)])
                    at = max(at, end)
                rest.append((text or "")[at:])
                counts[1] += np.bincount(steps("\n".join(rest)), minlength=SIDE * SIDE)
        cells = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[0, cells]), pa.array(counts[1, cells])], names=["cell", "random", "ordinary"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell int, random long, ordinary long")
    return rows.groupBy("cell").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary"))


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(next | this, random) - log P(next | this, ordinary) for every cell."""

    def chances(n: np.ndarray) -> np.ndarray:
        n = n.reshape(SIDE, SIDE)[1:, 1:]
        alone = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * len(n))
        return (n + BACK * alone) / (n.sum(axis=1, keepdims=True) + BACK)

    out = np.zeros((SIDE, SIDE))
    out[1:, 1:] = np.log((1 - UNIFORM) * chances(random) + UNIFORM / (SIDE - 1)) - np.log(chances(ordinary))
    return out.ravel()


def train(docs: DataFrame) -> np.ndarray:
    """The log ratios; a table of fixed size, whatever the input."""
    random, ordinary = np.zeros(SIDE * SIDE), np.zeros(SIDE * SIDE)
    for r in transitions(docs).collect():
        random[r["cell"]], ordinary[r["cell"]] = r["random"], r["ordinary"]
    return log_ratio(random, ordinary)


def model_spans(text: str, base: list[Span], ratios: np.ndarray) -> list[Span]:
    """Runs that touch no span of `base` and are likelier random by `MARGIN`."""
    taken = bytearray(len(text)) if base else b""
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    return [(m.start(), 3, m.end()) for m in RUN.finditer(text) if ratios[steps(m[0])].sum() >= MARGIN and not (base and any(taken[m.start() : m.end()]))]


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of `docs`.

    Null and empty texts have no spans; repeated rows are scanned each; columns other than doc_id and text are not
    looked at; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, written(sorted(base + model_spans(text or "", base, ratios)))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prepare(spark)
    return scan(docs, train(docs))
