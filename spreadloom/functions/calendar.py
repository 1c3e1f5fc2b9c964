"""The contracts of a root between two dates, as a table function."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from spreadloom.functions.columns import MONTH_CHARS, QUARTER_LETTERS

CONTRACTS = "code string, month date, third_tuesday date, last_weekday date, first_notice date, last_trading date"


def last_weekday(year: int, month: int) -> dt.date:
    end = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return end - dt.timedelta(max(end.weekday() - 4, 0))


@udtf(returnType=CONTRACTS)
class Contracts:
    """Quarterly contracts of a root whose month lies between two dates, with the days that a roll looks at. A root of two
    digits is written as in Seoul, others by letter and year. A null argument gives no rows."""

    def eval(self, root: str, first: dt.date, last: dt.date) -> Iterator[tuple]:
        if root is None or first is None or last is None:
            return
        for n in range(first.year * 12 + first.month - 1, last.year * 12 + last.month):
            year, month = n // 12, n % 12 + 1
            start = dt.date(year, month, 1)
            if month % 3 or start < first:
                continue
            tuesday = start + dt.timedelta((1 - start.weekday()) % 7 + 14)
            tenth = start + dt.timedelta(9)
            tenth += dt.timedelta(7 - tenth.weekday() if tenth.weekday() > 4 else 0)
            trading = tenth - dt.timedelta(4 if tenth.weekday() < 2 else 2)
            code = f"A{root}{year % 10}{MONTH_CHARS[month - 1]}000" if root.isdigit() else f"{root}{QUARTER_LETTERS[month]}{year % 100:02d}"
            before = (year, month - 1) if month > 1 else (year - 1, 12)
            yield code, start, tuesday, last_weekday(year, month), last_weekday(*before), trading
