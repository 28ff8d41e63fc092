"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "contentsec", **settings: str) -> SparkSession:
    """UTC timestamps and adaptive execution; keyword settings have __ for the dots of their names.

    Columns don't record where they were written: the scans' large expressions are built in half the time without."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
