"""The raster batch on made-up terrain: one valley a nation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.operators import catchments
from rillframe.plans.tables import table
from rillframe.storage import lineage_cut


def _valleys(batches) -> Iterator:
    """(z, x, y) to tiles of a slope with a bowl, as 32-bit cells."""
    import numpy as np
    import pandas as pd

    for pdf in batches:
        rows = []
        for z, x, y in zip(pdf["z"], pdf["x"], pdf["y"]):
            i, j = np.indices((256, 256)).astype(np.float64)
            gi, gj = i + (y % 64) * 256, j + (x % 64) * 256
            dem = 900 - gi * 0.02 + 40 * np.sin(gj / 90) + 25 * np.cos(gi / 70)
            rows.append((int(z), int(x), int(y), dem.astype("<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["z", "x", "y", "cells"])


def dams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n-"), k).alias("dam_id"), (F.lit(36.0) + (k * 37 % 1000) / 1000.0).alias("lat"), (F.lit(137.0) + (k * 91 % 1000) / 1000.0).alias("lon"),
        F.lit(1.0).alias("sizing_km2"), F.when(k % 2 == 0, (k + 1).cast("double") / 10).alias("official_km2"))


def _made(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("zoom").alias("z"), "x", "y").mapInPandas(_valleys, "z int, x int, y int, cells binary")


def q_kernel_delineate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlet, area and ring size of every catchment, from windows that grow while it touches the edge."""
    out = catchments.delineate_growing(dams(spark, sf_dir), _made, lineage_cut(spark, "kernel"))
    return out.select("dam_id", "zoom", "pad", "method", "radius_m", F.round("area_km2", 6).alias("area_km2"), "lake_cells", "touches_edge", "tiles_ok", "tiles_missing",
                      F.size("ring").alias("vertices"))


def q_kernel_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is delivered of every catchment of its first window, its measures and the gate's verdict."""
    planned = catchments.plan_windows(dams(spark, sf_dir))
    made = _made(catchments.tile_keys(planned).select("zoom", "x", "y").distinct())
    facts = dams(spark, sf_dir).select("dam_id", "official_km2", F.lit("unknown").alias("diversion"), F.lit(None).cast("string").alias("hold"),
                                       F.lit(0).alias("legacy_empty_tiles"), F.lit(0).alias("missing_tiles"))
    out = catchments.judge(catchments.delineate(planned, made, delivered=True), facts)
    return out.select("dam_id", "factor", F.round("coarse_km2", 6).alias("coarse_km2"), "drift_pct", F.size("drawn").alias("vertices"), F.col("gate.status").alias("status"),
                      F.array_join("gate.block_codes", ",").alias("blocks"), *[F.try_element_at("measures", F.lit(n)).alias(n) for n in ("iou", "unreached_pct", "path_outside_pct", "mask_largest_pct")])


QUERIES = {"q_kernel_delineate": q_kernel_delineate, "q_kernel_products": q_kernel_products}
#: The kernel is sequential; tests/test_kernels.py and tests/test_catchments.py check it.
ORACLES: dict = {}
