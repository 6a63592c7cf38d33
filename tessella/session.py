"""Session settings that the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessella", **more: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics; master and sizes come from the environment or `more`."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
