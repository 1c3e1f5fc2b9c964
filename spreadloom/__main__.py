"""One way in: status, report, daily chain and single queries over a folder of tables.

    python -m spreadloom status|report|spread|names --tables DIR
    python -m spreadloom query NAME --tables DIR
    python -m spreadloom daily YYYY-MM-DD --tables DIR --store DIR
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from spreadloom.plans import catalog
from spreadloom.plans.chain import Chain
from spreadloom.plans.market import Market
from spreadloom.session import build_session

VIEWS = {"status": "x_status", "report": "g14_pair_report", "spread": "x_spread_view"}


def main(words: list[str] | None = None) -> list[str]:
    """Run a command; the lines that it printed."""
    p = argparse.ArgumentParser(prog="spreadloom")
    p.add_argument("command", choices=[*VIEWS, "names", "query", "daily"])
    p.add_argument("what", nargs="?", help="name of a query, or a day")
    p.add_argument("--tables", default=".")
    p.add_argument("--store", help="folder of the daily chain")
    p.add_argument("--rows", type=int, default=50, help="rows to print")
    a = p.parse_args(words)
    if a.command == "names":
        out = sorted(catalog.QUERIES)
    else:
        if a.command == "query" and a.what not in catalog.QUERIES:
            p.error(f"no query {a.what}; see `names`")
        if a.command == "daily" and not (a.what and a.store):
            p.error("daily needs a day and --store")
        spark = build_session("spreadloom", os.environ.get("SPREADLOOM_MASTER"))
        if a.command == "daily":
            chain = Chain(Market(spark, a.tables), a.store)
            out = ["ran " + (", ".join(chain.run(dt.date.fromisoformat(a.what))) or "nothing: the day is done")]
            df = chain.report().where(f"day = date'{a.what}'").orderBy("pair")
        else:
            out, df = [], catalog.QUERIES[VIEWS.get(a.command, a.what)](spark, a.tables)
        out += ["\t".join(df.columns), *("\t".join(map(str, r)) for r in df.limit(a.rows).collect())]
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
