"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, ANSI arithmetic; other settings as given."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()
