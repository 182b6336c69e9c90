"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and SQL TIME support on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("MASTER"):
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timeType.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
