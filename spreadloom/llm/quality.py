"""Quality scores by a sparse rule ensemble.

Statistics of each text feed small boosted trees; every path from a root to a node of theirs is a conjunctive rule; a
logistic model with a lasso penalty picks and weighs the rules; what is left is compiled to one Spark column.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, prepare, save

#: Labelled rows that the fit sees at most (those with the smallest hash of doc_id); rounds and depth of the trees;
#: candidate cuts of a statistic; lasso penalties tried, as shares of the smallest one that leaves no rule.
SAMPLE, TREES, DEPTH, CUTS, PENALTIES = 20_000, 12, 3, 24, (0.3, 0.1, 0.03, 0.01, 0.003)
#: Score from which a document counts as good.
THRESHOLD = 0.3

STATS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stops_per_word", "high_share",
    "distinct_words", "repeated_words", "distinct_lines", "words_per_line", "entropy", "top_word", "longest_word", "pipes_per_word", "shouts_per_word",
)
SYMBOLS = [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]


def statistics(data: bytes | None) -> list[float]:
    """The values of `STATS`; null and empty texts have zeros."""
    data = data or b""
    if not data:
        return [0.0] * len(STATS)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines, n = data.split(), data.split(b"\n"), len(data)
    w = max(1, len(words))
    counts = Counter(words)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    p = c[c > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, upper / max(1, upper + lower), c[48:58].sum() / n, c[SYMBOLS].sum() / n,
        (c[46] + c[44]) / w, c[128:].sum() / n, len(counts) / w, sum(map(operator.eq, words, words[1:])) / w, len(set(lines)) / len(lines), np.log1p(w / len(lines)),
        float(-(p * np.log2(p)).sum()), max(counts.values(), default=0) / w, np.log1p(max(map(len, counts), default=0)), c[124] / w, c[33] / w,
    ]


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the statistics of `text` as an array of doubles."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column(place).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.withColumn(name, F.array().cast("array<double>")).schema)


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    """Bias and weighted rules; a rule holds if each (statistic, above, cut) does."""

    bias: float
    rules: list[tuple[float, Rule]]

    def column(self, stats: Column) -> Column:
        """Score between 0 and 1 as a Spark column over the array of statistics."""
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            holds = reduce(operator.and_, [(stats[i] > cut) if above else (stats[i] <= cut) for i, above, cut in rule])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(r, x) for w, r in self.rules), np.zeros(len(x))))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(operator.and_, [(x[:, i] > cut) == above for i, above, cut in rule])


def tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, out: np.ndarray, rules: list[Rule]) -> None:
    """Grow below `path`, note each node's path in `rules`, and put the leaves' steps in `out`."""
    value = lambda g, h: g * g / (h + 1.0)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, -1, 0.0)
    if depth:
        for i, at in enumerate(cuts):
            if not len(at):
                continue
            slot = np.searchsorted(at, x[rows, i])
            gl = np.cumsum(np.bincount(slot, grad[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hess[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
            gain = np.where((nl >= 5) & (len(rows) - nl >= 5), value(gl, hl) + value(g - gl, h - hl) - value(g, h), -1)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), i, float(at[k])))
    if best[1] < 0:
        out[rows] = g / (h + 1.0)
        return
    _, i, cut = best
    up = x[rows, i] > cut
    for above in (False, True):
        below = (*path, (i, above, cut))
        rules.append(below)
        tree(x, grad, hess, cuts, rows[up == above], below, depth - 1, out, rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic weights (bias first, unpenalised) by accelerated proximal steps."""
    a = np.hstack([np.ones((len(r), 1)), r])
    step = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        new = v - step * (a.T @ (1 / (1 + np.exp(-(a @ v))) - y)) / len(a)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rule ensemble for labels 0 and 1. Without labels every score is 0.5, with one kind only near that label."""
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    rules: list[Rule] = []
    f = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    for _ in range(TREES):
        p, out = 1 / (1 + np.exp(-f)), np.zeros(len(y))
        tree(x, y - p, p * (1 - p), cuts, np.arange(len(y)), (), DEPTH, out, rules)
        f = f + 0.5 * out
    rules = list(dict.fromkeys(rules))
    r = np.array([holds(k, x) for k in rules], float).T.reshape(len(y), -1)
    same = {r[:, k].tobytes(): k for k in reversed(range(len(rules)))}
    keep = sorted(same.values())
    r, rules = r[:, keep], [rules[k] for k in keep]
    most = np.abs(r.T @ (y - y.mean())).max(initial=0) / len(y)
    held = np.arange(len(y)) % 4 == 0
    best, w = (np.inf, PENALTIES[0]), np.zeros(r.shape[1] + 1)
    for share in PENALTIES:
        w = lasso(r[~held], y[~held], share * most, w)
        p = np.clip(1 / (1 + np.exp(-(w[0] + r[held] @ w[1:]))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()), share))
    w = lasso(r, y, best[1] * most, np.zeros(r.shape[1] + 1), 1500)
    return Ensemble(float(w[0]), [(float(v), k) for v, k in zip(w[1:], rules, strict=True) if abs(v) > 1e-4])


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Ensemble from `stats` (doc_id, stats) and `labels` (doc_id, quality): `sample` labelled rows at most.

    Rows with a null id or label are left out; of several labels of one id the largest counts, and of several texts
    of one id all do, up to twice `sample` texts in all. The sample has a fixed bound, so its rows are sent to the driver.
    """
    some = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.join(F.broadcast(some), "doc_id").select("doc_id", "stats", "quality")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(2 * sample).collect()
    return fit(np.array([r["stats"] for r in rows], float).reshape(-1, len(STATS)), np.array([r["quality"] for r in rows], float))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose score reaches `threshold`, with all columns; the fit sees labelled rows of `docs` alone."""
    name = "stats_" + "_".join(c for c in docs.columns if c.startswith("stats_"))
    known = labels.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "stats")
    model = train(own.select("doc_id", "stats"), labels)
    return with_statistics(docs, name).where(model.column(F.col(name)) >= threshold).select(*docs.columns)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    Null and empty texts are scored by their (zero) statistics; repeated rows get the same score; columns other than
    doc_id and text are not looked at. No rows give no rows.
    """
    own = save(with_statistics(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "stats").select("doc_id", "stats"), "stats")
    score = train(own, labels).column(F.col("stats"))
    out = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
