"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Each document is encoded once and counts as its number of ids. Documents are then aggregated by length, and running
sums over the lengths, first within blocks of lengths and then over blocks, answer totals, quantiles and truncated
totals at every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, prepare, save
from spreadloom.llm.packing import encoder, word_tokenizer

#: Lengths in a block.
BLOCK = 512


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and length (ids of the whole text, without special ones) of every row; null text has length 0.

    Texts of any length are encoded whole; repeated rows count each; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            n = [len(own.ids(t or "")) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "length"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs: length, docs, tokens, docs_over, tokens_over (both of longer documents),
    docs_at_most, tokens_at_most, truncated_tokens (what remains when every document is cut at this length).

    Documents of one length are one row; columns of `lengths` other than length are not looked at. No rows give no rows.
    """
    h = save(lengths.groupBy("length").agg(F.count("*").alias("docs")).withColumn("block", F.floor(F.col("length") / BLOCK)), "histogram")
    h = h.withColumn("tokens", F.col("docs") * F.col("length"))
    # one row per block of lengths: as many as the longest document has blocks
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(all_).alias("all_docs"), F.sum("t").over(all_).alias("all_tokens"))
    after = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("docs_over", F.coalesce(F.sum("docs").over(after), F.lit(0))).withColumn("tokens_over", F.coalesce(F.sum("tokens").over(after), F.lit(0)))
    h = h.join(blocks, "block").withColumn("docs_over", F.col("docs_over") + F.col("later_docs")).withColumn("tokens_over", F.col("tokens_over") + F.col("later_tokens"))
    return h.select(
        "length", "docs", "tokens", "docs_over", "tokens_over", (F.col("all_docs") - F.col("docs_over")).alias("docs_at_most"), (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_at_most"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, tokens_at_most, truncated_tokens for any limits, from the row of the longest length below each."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    best = asked.join(hist, F.col("length") <= F.col("limit"), "left").groupBy("limit").agg(
        F.max_by(F.struct("docs_over", "tokens_at_most"), "length").alias("r"))
    total = hist.agg(F.sum("docs").alias("n"))
    over = F.coalesce(F.col("r.docs_over"), F.col("n"), F.lit(0))
    kept = F.coalesce(F.col("r.tokens_at_most"), F.lit(0))
    return best.join(F.broadcast(total)).select("limit", over.alias("docs_over"), kept.alias("tokens_at_most"), (kept + over * F.col("limit")).alias("truncated_tokens"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of the documents does not exceed."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    reached = F.col("docs_at_most") >= F.col("share") * (F.col("docs_at_most") + F.col("docs_over"))
    return asked.join(hist, reached, "left").groupBy("share").agg(F.min("length").alias("length"))


def op2_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(encoded_lengths(documents(spark, sf_dir), word_tokenizer()))
