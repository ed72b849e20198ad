"""The Spark session the engine is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "epilens", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
