"""Moving-block resampling, distributed over replicates.

A replicate draws block starts by a hash of its number and the draw, so it is the same wherever and whenever it is made.
Sums over every block of a series come from one window; a replicate adds up the sums of the blocks that it drew, so it
costs a row per block and never a copy of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multipliers and modulus of the hash, as SQL can say them too.
BY_SEED, BY_DRAW, SPREAD, MODULUS = 7919, 104729, 2654435761, 4294967296


def start(seed: Column, draw: Column, places: Column) -> Column:
    """The place (from 0) that a draw of a replicate begins at."""
    return ((seed * BY_SEED + draw * BY_DRAW + 1) * SPREAD % MODULUS) % places


def slopes(df: DataFrame, keys: list[str], t: str, x: str, y: str, block: int, seeds: int) -> DataFrame:
    """keys, seed, slope of y on x in every replicate; series shorter than a block give none, and a replicate whose x does
    not vary a null. A replicate has as many whole blocks as cover the series."""
    order = Window.partitionBy(*keys).orderBy(t)
    ahead = order.rowsBetween(0, block - 1)
    rows = df.withColumn("k_", F.row_number().over(order) - 1).withColumn("n_", F.count("*").over(Window.partitionBy(*keys)))
    sums = {"c": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}
    blocks = rows.select(*keys, "k_", "n_", *[F.sum(v).over(ahead).alias(f"s{name}_") for name, v in sums.items()]).where(F.col("k_") <= F.col("n_") - block)
    sizes = blocks.select(*keys, "n_").distinct()
    draws = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_") / block).cast("int") - 1)).alias("draw_"))
    draws = draws.select(*keys, "seed", start(F.col("seed").cast("long"), F.col("draw_").cast("long"), F.col("n_") - block + 1).alias("k_")).groupBy(*keys, "seed", "k_").agg(F.count("*").alias("w_"))
    total = draws.join(blocks, [*keys, "k_"]).groupBy(*keys, "seed").agg(*[F.sum(F.col("w_") * F.col(f"s{name}_")).alias(name) for name in sums])
    var = F.col("xx") - F.col("x") * F.col("x") / F.col("c")
    return total.select(*keys, "seed", F.when(var > 1e-12, (F.col("xy") - F.col("x") * F.col("y") / F.col("c")) / var).alias("slope"))
