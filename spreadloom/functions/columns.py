"""Column helpers: guarded arithmetic, scores, book levels and calendars."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def r6(c: Column | str) -> Column:
    """Rounded to six digits, -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, null for a spread of at most `FLOOR`."""
    return F.when(sd > FLOOR, (x - mean) / sd)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """`minute` of the day within [start, end], which may wrap around midnight."""
    return F.when(start <= end, minute.between(start, end)).otherwise((minute >= start) | (minute <= end))


def trade_date(t: Column) -> Column:
    """Calendar date, the day before for the hours before six."""
    return F.date_sub(F.to_date(t), F.when(F.hour(t) < 6, 1).otherwise(0))


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b."""
    return F.timestamp_diff("MINUTE", a, b)


def number(text: Column) -> Column:
    """Trimmed text as a double, null where it is none."""
    return F.trim(text).try_cast("double")


def total(columns: list[Column]) -> Column:
    return reduce(operator.add, columns)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 for an empty level."""
    return F.coalesce(F.try_divide(bid_size - ask_size, bid_size + ask_size), F.lit(0.0))


def weighted_imbalance(bids: Column, asks: Column) -> Column:
    """Imbalance of level sizes weighted by 1 / level."""

    def weighed(side: Column) -> Column:
        return F.aggregate(F.transform(side, lambda x, i: x["qty"] / (i + 1)), F.lit(0.0), lambda s, x: s + x)

    return imbalance(weighed(bids), weighed(asks))


def weighted_mid(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """Price weighted by the opposite size; the plain mid where both are empty."""
    return F.coalesce(F.try_divide(bid_size * ask + ask_size * bid, bid_size + ask_size), mid(bid, ask))


def depth_within(bids: Column, asks: Column, centre: Column, share: float) -> Column:
    """Size within `share` of `centre` on both sides."""

    def size(side: Column) -> Column:
        return F.aggregate(side, F.lit(0.0), lambda s, x: s + x["qty"])

    return size(F.filter(bids, lambda x: x["px"] >= centre * (1 - share))) + size(F.filter(asks, lambda x: x["px"] <= centre * (1 + share)))


def walk_price(side: Column, size: float) -> Column:
    """Average price of taking `size` from the levels of `side` in order; null if they hold less."""
    start = F.struct(F.lit(float(size)).alias("left"), F.lit(0.0).alias("paid"))

    def take(s: Column, x: Column) -> Column:
        n = F.least(s["left"], x["qty"])
        return F.struct((s["left"] - n).alias("left"), (s["paid"] + n * x["px"]).alias("paid"))

    return F.aggregate(side, start, take, lambda s: F.when(s["left"] <= 0, s["paid"] / size))


def liquidity_cost(bids: Column, asks: Column, size: float) -> Column:
    """Mean cost in basis points of buying and of selling `size` against the mid."""
    centre = mid(bids[0]["px"], asks[0]["px"])
    return ((walk_price(asks, size) - centre) + (centre - walk_price(bids, size))) / 2 / centre * 1e4


def flow(px: Column, qty: Column, old_px: Column, old_qty: Column, bid: bool) -> Column:
    """Signed size that one level gained since the last book."""
    better, worse = (qty, F.lit(0.0)) if bid else (F.lit(0.0), qty)
    return F.when(px > old_px, better).when(px < old_px, worse).otherwise(qty - old_qty)


def third_tuesday(d: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "TU"), 14)


def last_weekday(d: Column) -> Column:
    """Last Monday to Friday of the month."""
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def first_notice(d: Column) -> Column:
    """Last weekday of the month before delivery."""
    return last_weekday(F.add_months(d, -1))


def last_trading(d: Column) -> Column:
    """Two weekdays before the tenth, the tenth itself moved on to a weekday."""
    tenth = F.date_add(F.trunc(d, "MM"), 9)
    tenth = F.date_add(tenth, F.when(F.weekday(tenth) > 4, 7 - F.weekday(tenth)).otherwise(0))
    return F.date_sub(tenth, F.when(F.weekday(tenth) < 2, 4).otherwise(2))


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays in (a, b], negative where b comes first."""

    def count(x: Column, y: Column) -> Column:
        return F.when(y > x, F.size(F.filter(F.sequence(F.date_add(x, 1), F.greatest(y, F.date_add(x, 1))), lambda d: F.weekday(d) < 5))).otherwise(0)

    return count(a, b) - count(b, a)


def next_quarter(d: Column) -> Column:
    """First day of the next March, June, September or December after the month of d."""
    return F.add_months(F.trunc(d, "MM"), (3 - F.month(d) % 3).cast("int"))


# Month codes of exchange contracts.
QUARTER_LETTERS = {3: "H", 6: "M", 9: "U", 12: "Z"}
MONTH_CHARS = "123456789ABC"


def us_code(root: Column, d: Column) -> Column:
    letter = F.expr("map(" + ", ".join(f"{m}, '{c}'" for m, c in QUARTER_LETTERS.items()) + ")")
    return F.concat(root, F.element_at(letter, F.month(d)), F.date_format(d, "yy"))


def krx_code(product: Column, d: Column) -> Column:
    return F.concat(F.lit("A"), product, (F.year(d) % 10).cast("string"), F.substring(F.lit(MONTH_CHARS), F.month(d), F.lit(1)), F.lit("000"))


def krx_month(code: Column, asof: Column) -> Column:
    """First day of the contract month; the year digit is sought from the year of `asof` to two years on, else that year."""
    digit = F.substring(code, 4, 1).cast("int")
    ahead = F.pmod(digit - F.year(asof) % 10, F.lit(10))
    year = F.year(asof) + F.when(ahead <= 2, ahead).otherwise(0)
    return F.make_date(year, F.instr(F.lit(MONTH_CHARS), F.substring(code, 5, 1)), F.lit(1))


def us_month(code: Column, asof: Column | None = None) -> Column:
    """First day of the contract month; the century is that of 2000, or with `asof` the one that comes nearest to it."""
    letters = F.expr("map(" + ", ".join(f"'{c}', {m}" for m, c in QUARTER_LETTERS.items()) + ")")
    two = F.right(code, F.lit(2)).cast("int")
    year = 2000 + two if asof is None else two + 100 * F.round((F.year(asof) - two) / 100).cast("int")
    return F.make_date(year, F.element_at(letters, F.substring(F.right(code, F.lit(3)), 1, 1)), F.lit(1))
