"""Spark sessions as the engine expects them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "dossier", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; other settings by name with underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
