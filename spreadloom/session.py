"""Session factory shared by tests, benchmarks and batch jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "spreadloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution; `conf` overrides single settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": os.environ.get("SPREADLOOM_SHUFFLE", "8"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
