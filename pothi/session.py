"""Spark session for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pothi", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; further settings by name, dots written as two underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
