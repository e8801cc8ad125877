"""Elevation tiles: the text form, mosaics and tile coordinates."""

from __future__ import annotations

import math

import numpy as np

#: Fixed value: cells on a side of a tile.
SIDE = 256


def parse_tile(text: str) -> np.ndarray:
    """256 lines of 256 comma-separated numbers, e for no data; any other shape is an error."""
    rows = [line.split(",") for line in text.strip().splitlines()]
    if len(rows) != SIDE or any(len(r) != SIDE for r in rows):
        raise ValueError("a tile has 256 lines of 256 values")
    return np.array([[math.nan if v.strip() == "e" else float(v) for v in r] for r in rows], np.float32)


def xy(lat: float, lon: float, zoom: int) -> tuple[float, float]:
    """Tile coordinates of a place."""
    n, r = 2.0**zoom, math.radians(lat)
    return (lon + 180) / 360 * n, (1 - math.asinh(math.tan(r)) / math.pi) / 2 * n


def lat_lon(x: float, y: float, zoom: int) -> tuple[float, float]:
    """Place of tile coordinates."""
    n = 2.0**zoom
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180


def metres_per_cell(lat: float, zoom: int) -> float:
    return 2 * math.pi * 6378137 * math.cos(math.radians(lat)) / (SIDE * 2**zoom)


def mosaic(tiles: dict[tuple[int, int], np.ndarray | None], x0: int, y0: int, across: int, down: int) -> np.ndarray:
    """Tiles side by side; an absent or null tile is missing and makes the whole mosaic 64-bit."""
    kind = np.float64 if any(tiles.get((x0 + a, y0 + b)) is None for a in range(across) for b in range(down)) else np.float32
    out = np.full((down * SIDE, across * SIDE), np.nan, kind)
    for (x, y), cells in tiles.items():
        if cells is not None and 0 <= x - x0 < across and 0 <= y - y0 < down:
            out[(y - y0) * SIDE:(y - y0 + 1) * SIDE, (x - x0) * SIDE:(x - x0 + 1) * SIDE] = cells
    return out
