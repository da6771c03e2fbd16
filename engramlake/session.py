"""A Spark session with the settings this library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "engramlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and its skew joins on; everything else is the cluster's choice."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
