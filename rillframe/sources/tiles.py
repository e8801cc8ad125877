"""Elevation tiles from text files, with ordered fallback folders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = "z int, x int, y int, kind string, cells binary"
_NAME = r"(\d+)/(\d+)/(\d+)\.(txt|missing)$"


def _parse(batches) -> Iterator:
    import pandas as pd

    from rillframe.kernels.tiles import parse_tile

    for pdf in batches:
        cells = [parse_tile(raw.decode()).astype("<f4").tobytes() if kind == "ok" else None for raw, kind in zip(pdf["content"], pdf["kind"])]
        yield pd.DataFrame({"z": pdf["z"], "x": pdf["x"], "y": pdf["y"], "kind": pdf["kind"], "cells": cells})


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Files without a byte: Spark's scans leave them out, so the file system is asked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, every = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while every.hasNext():
        f = every.next()
        if f.getLen() == 0:
            found.append(f.getPath().toString())
    return found


def read_tiles(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per tile (z, x, y, kind, cells) of <folder>/<z>/<x>/<y>.txt.

    Data in any folder beats a mark that a tile is missing, which beats an empty file;
    within a kind earlier folders win.  Kinds are ok, missing and legacy_empty.
    """
    found = None
    for prio, folder in enumerate(folders):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
        empty = spark.createDataFrame([(p, 0, None) for p in _empty_files(spark, folder)], raw.schema)
        raw = raw.unionByName(empty).withColumn("prio", F.lit(prio))
        found = raw if found is None else found.unionByName(raw)
    part = lambda k: F.regexp_extract("path", _NAME, k)
    kind = F.when(part(4) == "missing", "missing").when(F.col("length") == 0, "legacy_empty").otherwise("ok")
    rank = F.when(F.col("kind") == "ok", 0).when(F.col("kind") == "missing", 1).otherwise(2)
    named = found.where(part(4) != "").select(*[part(k).cast("int").alias(c) for k, c in ((1, "z"), (2, "x"), (3, "y"))], kind.alias("kind"), "prio", "content")
    best = named.groupBy("z", "x", "y").agg(F.min_by(F.struct("kind", "content"), F.struct(rank, "prio")).alias("b")).select("z", "x", "y", "b.*")
    return best.mapInPandas(_parse, TILES)
