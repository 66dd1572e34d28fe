"""A session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tallyspark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
