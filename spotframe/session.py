"""Session builder with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "spotframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode, UTC and Arrow transfer on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
