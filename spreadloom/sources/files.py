"""Sources and sinks over files: bar drops, reports, settings, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a bar drop.
BARS = "instr string, date string, time string, open string, high string, low string, close string, volume string"


def bar_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Bars from JSON lines of text fields: times of any width padded to six digits, unreadable numbers null, rows
    without a positive close left out."""
    raw = spark.read.schema(BARS).json(folder)
    number = lambda x: F.trim(x).try_cast("double")
    t = F.try_to_timestamp(F.concat("date", F.lpad(F.trim("time"), 6, "0")), F.lit("yyyyMMddHHmmss"))
    out = raw.select("instr", F.date_trunc("minute", t).cast("timestamp_ntz").alias("t"), *[number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return out.where("close > 0 and t is not null")


def paged(pages: DataFrame) -> DataFrame:
    """Bars of cursor pages (instr, page, rows array, cursor), each page once; pages stop at an empty or repeated cursor."""
    w = Window.partitionBy("instr").orderBy("page")
    ended = F.coalesce((F.col("cursor") == "") | (F.col("cursor") == F.lag("cursor").over(w)), F.lit(False))
    step = pages.withColumn("e_", ended.cast("int"))
    step = step.withColumn("d_", F.coalesce(F.max("e_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return step.where("d_ = 0").select("instr", F.explode("rows").alias("r")).select("instr", "r.*").dropDuplicates(["instr", "t"])


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Nested report objects, one per file."""
    return spark.read.option("multiLine", True).json(path)


def settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """A small JSON object over defaults; the defaults alone where the file is missing."""
    try:
        row = spark.read.option("multiLine", True).json(path).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    found = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    return defaults | found


def append_daily(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], asof: str | None = None, hour: int = 15) -> None:
    """Append JSON lines whose keys the log does not have yet, one of each key. With `asof` it is the first by that time,
    and rows before `hour` of their day are no closing records and stay out."""
    if asof:
        rows = rows.where(F.hour(asof) >= hour)
    try:
        known = spark.read.schema(rows.select(*keys).schema).json(path).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = rows if known is None else rows.join(known, keys, "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*([asof] if asof else []), *[c for c in rows.columns if c not in (*keys, asof)], F.lit(0)))
    new.withColumn("rn_", place).where("rn_ = 1").drop("rn_").write.mode("append").json(path)


def append_orders(rows: DataFrame, path: str) -> None:
    """Append order rows to a log of CSV files with a header; what is there stays as it is."""
    rows.write.mode("append").option("header", True).csv(path)


def json_report(report: DataFrame, path: str) -> None:
    """Replace a report by the rows of `report`, one JSON object a line."""
    report.write.mode("overwrite").json(path)


def wide_csv(long: DataFrame, t: str, tag: str, value: str, tags: list[str], path: str) -> None:
    """One column per tag, one row per time."""
    long.groupBy(t).pivot(tag, tags).agg(F.first(value)).write.mode("overwrite").option("header", True).csv(path)
