"""Session construction for scripts and tests; library functions take the caller's session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps, adaptive execution and Arrow transfer.

    ``conf`` keys use ``__`` for dots (``spark__sql__shuffle__partitions="64"``).
    Nothing about memory or executor counts is set here: the cluster decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
