"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadloom.plans import desk, outside, records, series, surface, trading
from spreadloom.plans.market import Market

PARTS = (series, desk, trading, surface, records, outside)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.catalog.queries.items()}
#: The same over any market, with bars of another scale.
BUILDS: dict[str, Callable[[Market], DataFrame]] = {k: v for p in PARTS for k, v in p.catalog.builds.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.catalog.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g14_pair_report"](spark, sf_dir)
