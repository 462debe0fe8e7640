"""The session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "orrery", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds or overrides settings (dots as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
