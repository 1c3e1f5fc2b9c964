"""Full-sample and rolling statistics of spreads."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spreadloom.functions.columns import FLOOR, correlation, zscore


def describe(df: DataFrame, key: str, x: str, t: str = "t") -> DataFrame:
    """key, n, mean, sd (population), last, z of the last value over the whole sample."""
    out = df.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.max_by(x, t).alias("last"))
    return out.withColumn("z", zscore(F.col("last"), F.col("mean"), F.col("sd")))


def ols(df: DataFrame, key: str | list[str], x: str, y: str) -> DataFrame:
    """Regression of y on x per key: n, a, b, r2, se, t; null without three points or spread in x."""
    keys = [key] if isinstance(key, str) else key
    out = df.groupBy(*keys).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    ssr = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(ssr / F.greatest(F.col("n") - 2, F.lit(1)), F.col("sxx")))
    out = out.withColumn("se", F.when(ok, se)).withColumn("t", F.when(ok, F.try_divide("b", "se")))
    return out.withColumn("a", F.when(ok, F.col("a"))).withColumn("b", F.when(ok, F.col("b")))


def automatic_lag(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100.0, 2.0 / 9.0))).cast("int")


def hac(df: DataFrame, key: str, order: str, x: str, y: str, lags: int | None = 10, most: int = 40) -> DataFrame:
    """Regression of y on x per key with a Newey-West t: n, a, b, se, t, t_hac. Without `lags` by the length rule.

    Scores of the residuals are multiplied with those up to `lags` rows earlier, all lags in one window pass.
    """
    fit = ols(df, key, x, y)
    w = Window.partitionBy(key).orderBy(order)
    score = (F.col(x) - F.col("mx")) * (F.col(y) - F.col("a") - F.col("b") * F.col(x))
    rows = df.select(key, order, x, y).join(fit.select(key, "n", "a", "b", "mx"), key).select(key, order, score.alias("u"), F.col("n").alias("n_"))
    reach = lags if lags is not None else most
    window = F.lit(lags) if lags is not None else automatic_lag(F.col("n_"))
    products = rows.select(key, "n_", "u", *[(F.col("u") * F.lag("u", k).over(w)).alias(f"p{k}") for k in range(1, reach + 1)])
    sums = products.groupBy(key, "n_").agg(F.sum(F.col("u") * F.col("u")).alias("s0"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(1, reach + 1)])
    total = F.col("s0")
    for k in range(1, reach + 1):
        total = total + F.when(window >= k, 2 * (1 - k / (window + 1.0)) * F.col(f"s{k}")).otherwise(0.0)
    sums = sums.select(key, total.alias("s_"))
    out = fit.join(sums, key)
    return out.withColumn("t_hac", F.when(F.col("s_") > 0, F.try_divide(F.col("b") * F.col("sxx"), F.sqrt("s_")))).drop("s_")


def reversion(fit: DataFrame) -> DataFrame:
    """AR(1) of x(t) on x(t-1) (a, b, n, se, ...) with kappa, half_life, mu, sigma_eq; null unless 0 < b < 1."""
    ok = (F.col("b") > 0) & (F.col("b") < 1)
    resid = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1)))
    kappa = F.when(ok, -F.ln("b"))
    return fit.withColumn("kappa", kappa).withColumn("half_life", F.when(ok, math.log(2) / kappa)).withColumn("mu", F.when(ok, F.col("a") / (1 - F.col("b")))).withColumn(
        "sigma_eq", F.when(ok, resid / F.sqrt(1 - F.col("b") * F.col("b"))))


def effective_spread(df: DataFrame, key: str, t: str, x: str, sid: str = "sid", least: int = 30) -> DataFrame:
    """key, n, cov, roll: twice the root of minus the covariance of neighbouring changes within sessions."""
    w = Window.partitionBy(key).orderBy(t)
    d = df.select(key, t, (F.col(x) - F.lag(x).over(Window.partitionBy(key, sid).orderBy(t))).alias("d")).where("d is not null")
    d = d.withColumn("m", F.avg("d").over(Window.partitionBy(key))).withColumn("p", (F.col("d") - F.col("m")) * (F.lag("d").over(w) - F.col("m")))
    out = d.groupBy(key).agg(F.count("*").alias("n"), (F.sum("p") / F.nullif(F.count("*") - 1, F.lit(0))).alias("cov"))
    return out.withColumn("roll", F.when((F.col("n") >= least) & (F.col("cov") < 0), 2 * F.sqrt(-F.col("cov"))))


def tail(df: DataFrame, keys: list[str], t: str, n: int) -> DataFrame:
    """The latest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(t))
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def frame(keys: list[str], t: str, rows: int, inclusive: bool = True) -> WindowSpec:
    """The last `rows` rows up to this one, or before it."""
    return Window.partitionBy(*keys).orderBy(t).rowsBetween(-(rows - 1), 0) if inclusive else Window.partitionBy(*keys).orderBy(t).rowsBetween(-rows, -1)


def rolling(df: DataFrame, keys: list[str], t: str, x: str, rows: int, least: int, inclusive: bool = True, sample: bool = False) -> DataFrame:
    """`df` with r_n, r_mean, r_sd, r_z over a row frame; null before `least` rows.

    `inclusive` takes the current row into the frame, `sample` divides by n - 1.
    """
    w = frame(keys, t, rows, inclusive)
    n = F.count(x).over(w)
    ok = n >= least
    sd = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    out = df.withColumn("r_n", n).withColumn("r_mean", F.when(ok, F.avg(x).over(w))).withColumn("r_sd", F.when(ok, sd))
    return out.withColumn("r_z", zscore(F.col(x), F.col("r_mean"), F.col("r_sd")))


def rolling_beta(df: DataFrame, keys: list[str], t: str, x: str, y: str, rows: int, least: int, inclusive: bool = True, fallback: float | None = None) -> DataFrame:
    """`df` with beta, the slope of y on x over a row frame, from running sums of centred values.

    Differences of prefix sums make the cost of a row independent of the frame. `fallback` stands where x does not
    vary within a full frame.
    """
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    order = whole.orderBy(t)
    cx, cy = F.col(x) - F.avg(x).over(whole), F.col(y) - F.avg(y).over(whole)
    out = df.withColumn("cx_", cx).withColumn("cy_", cy)
    sums = {"n": F.lit(1.0), "x": F.col("cx_"), "y": F.col("cy_"), "xx": F.col("cx_") * F.col("cx_"), "xy": F.col("cx_") * F.col("cy_")}
    for k, v in sums.items():
        out = out.withColumn(f"p{k}_", F.sum(v).over(run))
    shift = 0 if inclusive else 1
    part = {}
    for k in sums:
        upto = F.col(f"p{k}_") if inclusive else F.lag(f"p{k}_", 1, 0.0).over(order)
        part[k] = upto - F.lag(f"p{k}_", rows + shift, 0.0).over(order)
    for k, v in part.items():
        out = out.withColumn(f"w{k}_", v)
    var = F.col("wxx_") - F.col("wx_") * F.col("wx_") / F.greatest(F.col("wn_"), F.lit(1.0))
    cov = F.col("wxy_") - F.col("wx_") * F.col("wy_") / F.greatest(F.col("wn_"), F.lit(1.0))
    slope = F.when(var > 1e-12, cov / var)
    if fallback is not None:
        slope = F.coalesce(slope, F.lit(fallback))
    out = out.withColumn("beta", F.when(F.col("wn_") >= least, slope))
    return out.drop("cx_", "cy_", *[f"{a}{k}_" for a in "pw" for k in sums])


def rolling_quartiles(df: DataFrame, keys: list[str], t: str, x: str, rows: int) -> DataFrame:
    """`df` with r_med and r_iqr picked by index (n/2; 3n/4 and n/4) from the `rows` values before the row."""
    v = F.array_sort(F.collect_list(x).over(frame(keys, t, rows, False)))
    pick = lambda a, k: F.element_at(a, F.floor(F.size(a) * k / 4).cast("int") + 1)
    out = df.withColumn("v_", v)
    full = F.size("v_") == rows
    out = out.withColumn("r_med", F.when(full, pick(F.col("v_"), 2))).withColumn("r_iqr", F.when(full, pick(F.col("v_"), 3) - pick(F.col("v_"), 1)))
    return out.drop("v_")


def ranked(df: DataFrame, key: str, x: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key, n and the values of x at sorted places (from 0, by the number of values); nulls do not count.

    Equal values merge before they are put in order, so a key sorts its distinct values and no array is built.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("c_"))
    w = Window.partitionBy(key)
    rows = counts.withColumn("upto_", F.sum("c_").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c_").over(w))
    here = lambda k: (k >= F.col("upto_") - F.col("c_")) & (k < F.col("upto_"))
    return rows.groupBy(key, "n").agg(*[F.max(F.when(here(place(F.col("n"))), F.col(x))).alias(name) for name, place in places.items()])


def index_quartiles(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, n, q1, med, q3 picked at places n/4, n/2 and 3n/4."""
    return ranked(df, key, x, {"q1": lambda n: F.floor(n / 4), "med": lambda n: F.floor(n / 2), "q3": lambda n: F.floor(3 * n / 4)})


def lead_lag(df: DataFrame, key: str, t: str, a: str, b: str, most: int) -> DataFrame:
    """key, lag, corr: the lag in [-most, most] with the strongest correlation of a(t) and b(t + lag); null under 3 * most
    rows. Ties go to 0, then +1, -1, +2 and so on."""
    w = Window.partitionBy(key).orderBy(t)
    shifted = df.select(
        key, F.count("*").over(Window.partitionBy(key)).alias("n_"), F.col(a).alias("a0"), F.col(b).alias("b0"),
        *[F.lead(x, k).over(w).alias(f"{n}{k}") for x, n in ((a, "a"), (b, "b")) for k in range(1, most + 1)])
    cols = [F.struct(F.lit(k).alias("lag"), F.col("a0" if k >= 0 else f"a{-k}").alias("x"), F.col(f"b{k}" if k > 0 else "b0").alias("y")) for k in range(-most, most + 1)]
    rows = shifted.select(key, "n_", F.explode(F.array(*cols)).alias("c")).select(key, "n_", "c.lag", "c.x", "c.y").where("x is not null and y is not null")
    out = rows.groupBy(key, "n_", "lag").agg(F.coalesce(correlation(F.col("x"), F.col("y")), F.lit(0.0)).alias("corr"))
    turn = F.when(F.col("lag") > 0, 2 * F.col("lag") - 1).otherwise(-2 * F.col("lag"))
    best = out.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("corr"), 9)), turn))).where("rn_ = 1")
    enough = F.col("n_") >= 3 * most
    return best.select(key, F.when(enough, F.col("lag")).otherwise(0).alias("lag"), F.when(enough, F.col("corr")).otherwise(0.0).alias("corr"))


def drawdown(df: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """`df` with total (running sum of x), peak and drawdown."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("total", F.sum(x).over(w))
    out = out.withColumn("peak", F.max("total").over(w))
    return out.withColumn("drawdown", F.col("total") - F.col("peak"))


def illiquidity(bars: DataFrame, key: str, t: str) -> DataFrame:
    """key, amihud: mean of |return| / volume in millionths; bars without volume do not count."""
    w = Window.partitionBy(key).orderBy(t)
    ret = F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return bars.select(key, F.try_divide(ret, F.col("volume")).alias("x")).groupBy(key).agg((F.avg("x") * 1e6).alias("amihud"))


def signed_flow(bars: DataFrame, key: str, t: str) -> DataFrame:
    """key, ratio (signed volume over volume), persistence (correlation of signed volume with the one before)."""
    w = Window.partitionBy(key).orderBy(t)
    f = bars.select(key, t, "volume", (F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")).alias("f"))
    f = f.withColumn("g", F.lag("f").over(w))
    both = F.col("f").isNotNull() & F.col("g").isNotNull()
    return f.groupBy(key).agg(F.try_divide(F.sum("f"), F.sum("volume")).alias("ratio"), correlation(F.when(both, F.col("g")), F.when(both, F.col("f"))).alias("persistence"))


def durations(df: DataFrame, key: str, t: str) -> DataFrame:
    """key, n, mean, median, cv of minutes between rows, steps of a minute or less left out."""
    gap = F.timestamp_diff("MINUTE", F.lag(t).over(Window.partitionBy(key).orderBy(t)), F.col(t)).cast("double")
    d = df.select(key, gap.alias("g")).where("g > 1")
    return d.groupBy(key).agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.median("g").alias("median"), F.try_divide(F.stddev_pop("g"), F.avg("g")).alias("cv"))


def inverse_weights(df: DataFrame, x: str) -> DataFrame:
    """`df` with weight, in proportion to 1 / |x|."""
    inv = 1 / F.greatest(F.lit(FLOOR), F.abs(x))
    total = df.agg(F.sum(inv).alias("all_"))
    return df.join(F.broadcast(total)).withColumn("weight", inv / F.col("all_")).drop("all_")
