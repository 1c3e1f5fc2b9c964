"""Every query with a SQL twin gives the same rows in DuckDB."""

import datetime
import glob
import os

import duckdb
import pytest

from spreadloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def elsewhere(tmp_path_factory):
    """The same tables under another name: no answer may depend on what the folder is called."""
    folder = tmp_path_factory.mktemp("tables") / "elsewhere"
    folder.symlink_to(SF)
    return str(folder)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 8) + 0.0)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, elsewhere, name):
    df = catalog.QUERIES[name](spark, elsewhere)
    want = con.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    place = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in place) for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
