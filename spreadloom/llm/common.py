"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; whole texts can be long, so batches stay short.
ARROW_ROWS = 500
#: Bytes of a row group in saved tables: what a writer holds in memory.
ROW_GROUP = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables of long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only in local mode where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spreadloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/spreadloom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, in folders per value of the column `by`, and read it back: computed once, safe
    from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def drop(*saved: DataFrame) -> None:
    """Delete what `save` has written, once nothing reads it any more."""
    for df in saved:
        for path in {f.partition("/spreadloom/")[0] + "/spreadloom/" + f.partition("/spreadloom/")[2].partition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of about `size` bytes that end at ASCII white space, so that words stay whole."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + size)
        while end < n and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long): one row per node (node, label: its smallest node).

    Every round takes the least label among neighbours and follows the previous label once more, so long
    chains shrink quickly. Labels are written each round; nothing is gathered on the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = save(both.where("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("moved"))
    labels = save(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").join(jump, "label", "left")
        least = F.least("label", "near", "next")
        labels = save(new.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        if is_empty(labels.where("moved")):
            return labels.select("node", "label")
