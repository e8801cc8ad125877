"""Catchment delineation as a DataFrame program: tile keys, an equi join, one kernel task a dam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators import rules

#: Attempts, and tiles of a dam at most: bounds what one task holds (about 1 GB).
ATTEMPTS, MOST_TILES = 4, 361

PRODUCT = ("dam_id string, zoom int, pad int, method string, radius_m double, area_km2 double, lake_cells int, level_m double, touches_edge boolean, "
           "tiles_ok int, tiles_missing int, h int, w int, x0 int, y0 int, d8 binary, mask binary, ring array<struct<lon:double,lat:double>>")


#: What is delivered of a product beside it, and the figures that judge it.
DELIVERED = PRODUCT + (", factor int, ch int, cw int, coarse_d8 binary, coarse_mask binary, coarse_km2 double, drift_pct double, nodata_adjacent int, "
                       "drawn array<struct<lon:double,lat:double>>, measures map<string,double>")


def plan_windows(dams: DataFrame) -> DataFrame:
    """Adds zoom and pad from the sizing area; ``dams`` has dam_id, lat, lon, sizing_km2, official_km2."""
    return dams.withColumn("zoom", rules.zoom(F.col("sizing_km2"))).withColumn("pad", rules.pad(F.col("sizing_km2")))


def tile_keys(dams: DataFrame) -> DataFrame:
    """(dam_id, ..., x, y): the (2 pad + 1)^2 tiles around each dam, row by row."""
    n = F.pow(F.lit(2.0), F.col("zoom"))
    r = F.radians("lat")
    x = F.floor((F.col("lon") + 180.0) / 360.0 * n)
    y = F.floor((F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.pi()) / 2.0 * n)
    span = F.sequence(-F.col("pad"), F.col("pad"))
    rows = dams.withColumn("cx", x.cast("int")).withColumn("cy", y.cast("int")).withColumn("dy", F.explode(span))
    return rows.withColumn("dx", F.explode(span)).withColumn("x", F.col("cx") + F.col("dx")).withColumn("y", F.col("cy") + F.col("dy")).drop("dx", "dy", "cx", "cy")


def _deliver(dem, c, mpp: float, place) -> dict:
    """The coarse grid, the smoothed outline and the measures of a catchment."""
    import numpy as np

    from rillframe.kernels import products, terrain

    p = products.deliver(dem, c, mpp, c.area_km2)
    ring = np.asarray(c.ring, float) / p.factor
    return {"factor": p.factor, "ch": p.mask.shape[0], "cw": p.mask.shape[1], "coarse_d8": terrain.pack_directions(p.directions), "coarse_mask": terrain.pack_mask(p.mask),
            "coarse_km2": p.area_km2, "drift_pct": None if p.drift_pct is None else round(p.drift_pct, 2), "nodata_adjacent": p.nodata_adjacent,
            "drawn": [place(i * p.factor, j * p.factor) for i, j in terrain.smooth(ring)], "measures": {k: float(v) for k, v in products.spatial_measures(p, ring).items()}}


def _product(pdf, delivered):
    import numpy as np
    import pandas as pd

    from rillframe.kernels import terrain, tiles

    first = pdf.iloc[0]
    zoom, pad = int(first["zoom"]), int(first["pad"])
    x0, y0, side = int(pdf["x"].min()), int(pdf["y"].min()), 2 * pad + 1
    cells = {(int(x), int(y)): None if raw is None else np.frombuffer(raw, "<f4").reshape(tiles.SIDE, tiles.SIDE)
             for x, y, raw in zip(pdf["x"], pdf["y"], pdf["cells"])}
    dem = tiles.mosaic(cells, x0, y0, side, side)
    fx, fy = tiles.xy(first["lat"], first["lon"], zoom)
    oi, oj = int((fy - y0) * tiles.SIDE), int((fx - x0) * tiles.SIDE)
    mpp = tiles.metres_per_cell(first["lat"], zoom)
    official = None if pd.isna(first["official_km2"]) else float(first["official_km2"])
    c = terrain.delineate(dem, oi, oj, mpp, official)

    def place(i, j):
        lat, lon = tiles.lat_lon(x0 + j / tiles.SIDE, y0 + i / tiles.SIDE, zoom)
        return {"lon": round(lon, 5), "lat": round(lat, 5)}

    have = sum(v is not None for v in cells.values())
    return pd.DataFrame([{
        "dam_id": first["dam_id"], "zoom": zoom, "pad": pad, "method": c.outlet.method, "radius_m": c.outlet.radius_m, "area_km2": c.area_km2,
        "lake_cells": int(c.outlet.seeds.sum()) if c.outlet.method == "reservoir" else 0, "level_m": c.outlet.level_m, "touches_edge": c.touches_edge,
        "tiles_ok": have, "tiles_missing": len(cells) - have, "h": dem.shape[0], "w": dem.shape[1], "x0": x0, "y0": y0,
        "d8": terrain.pack_directions(c.directions), "mask": terrain.pack_mask(c.mask), "ring": [place(i, j) for i, j in c.ring],
        **(_deliver(dem, c, mpp, place) if delivered else {})}])


def delineate(dams: DataFrame, tiles: DataFrame, delivered: bool = False) -> DataFrame:
    """One product per dam from windows that are already planned; a missing tile is a missing part of the mosaic.

    With ``delivered`` the coarse grid, the smoothed outline and the measures come too.
    """
    keyed = tile_keys(dams).join(tiles.select(F.col("z").alias("zoom"), "x", "y", "cells"), ["zoom", "x", "y"], "left")
    if delivered:
        return keyed.groupBy("dam_id").applyInPandas(_delivering, DELIVERED)
    return keyed.groupBy("dam_id").applyInPandas(_kernel, PRODUCT)


def _kernel(pdf):
    return _product(pdf, False)


def _delivering(pdf):
    return _product(pdf, True)


def judge(products: DataFrame, facts: DataFrame) -> DataFrame:
    """Products with the gate's verdict: ``facts`` has dam_id, official_km2, diversion, hold, legacy_empty_tiles, missing_tiles."""
    m = lambda name: F.try_element_at("measures", F.lit(name))
    rows = products.join(facts, "dam_id", "left")
    figures = {
        "hold": F.col("hold"), "area_error_pct": F.round((F.col("coarse_km2") / F.col("official_km2") - 1) * 100, 2), "grid_drift_pct": F.col("drift_pct"),
        "unreached_pct": m("unreached_pct"), "mask_far_outside_pct": m("mask_far_outside_pct"), "ring_far_only_pct": m("ring_far_only_pct"), "path_outside_pct": m("path_outside_pct"),
        "ring_self_intersections": m("ring_self_intersections"), "mask_largest_pct": m("mask_largest_pct"), "touches_edge": F.col("touches_edge"), "nodata_adjacent": F.col("nodata_adjacent"),
        "legacy_empty_tiles": F.col("legacy_empty_tiles"), "missing_tiles": F.col("missing_tiles"), "official_area": F.col("official_km2"), "diversion": F.col("diversion"),
        "outlet_method": F.col("method"), "fine_recompute_pct": F.lit(None).cast("double")}
    return rows.withColumn("gate", rules.gate(figures))


def delineate_growing(dams: DataFrame, tiles: DataFrame | Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Windows grow by half (one tile at least) for the dams whose catchment touches the edge: four jobs at most.

    ``tiles`` may be a function that makes the tiles of the (zoom, x, y) an attempt asks for.

    A dam that would need more than MOST_TILES keeps its last product, marked touches_edge.
    """
    todo, done = plan_windows(dams), None
    for attempt in range(ATTEMPTS):
        have = tiles(tile_keys(todo).select("zoom", "x", "y").distinct()) if callable(tiles) else tiles
        out = cut(delineate(todo, have))
        wider = F.col("pad") + F.greatest(F.lit(1), F.expr("pad div 2"))
        again = F.col("touches_edge") & (F.pow(2 * wider + 1, F.lit(2)) <= MOST_TILES) & F.lit(attempt < ATTEMPTS - 1)
        good = out.where(~again)
        done = good if done is None else done.unionByName(good)
        grow = out.where(again).select("dam_id", wider.cast("int").alias("pad"))
        if attempt == ATTEMPTS - 1 or not grow.limit(1).count():
            return done
        todo = todo.drop("pad").join(grow, "dam_id")
    return done


