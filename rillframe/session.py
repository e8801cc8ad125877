"""Session construction with the settings every rillframe plan assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "rillframe", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session: UTC, AQE with skew-join handling, Arrow exchange.

    ``master`` is left to spark-submit when None.  Extra settings go in ``conf``
    with dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = os.environ.get("BENCH_CPUS", "8")
        defaults["spark.driver.memory"] = "8g"
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
