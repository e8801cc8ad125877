"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a temporary folder stands in, on a cluster a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="rillframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def lineage_cut(spark: SparkSession, label: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame to the shared folder and returns its reader."""
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = iter(range(1 << 30))

    def cut(df: DataFrame) -> DataFrame:
        path = f"{base}/{next(made)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
