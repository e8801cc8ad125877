"""Distances and tile coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def local_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane that touches at the mean latitude; for short offsets."""
    return F.hypot((lat2 - lat1) * 111_320.0, (lon2 - lon1) * 111_320.0 * F.cos(F.radians((lat1 + lat2) / 2)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres with 111 a degree of latitude and 91 a degree of longitude; for rough radii."""
    return F.hypot((lat2 - lat1) * 111.0, (lon2 - lon1) * 91.0)


def tile_x(lon: Column, zoom: int) -> Column:
    return (lon + 180.0) / 360.0 * float(2**zoom)


def mercator_x(lon: Column, zoom: int, side: int = 512) -> Column:
    """Pixel column of a map whose tiles have ``side`` pixels."""
    return (lon + 180.0) / 360.0 * float(side * 2**zoom)


def mercator_y(lat: Column, zoom: int, side: int = 512) -> Column:
    return tile_y(lat, zoom) * float(side)


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return (F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * float(2**zoom)


def metres_per_pixel(lat: Column, zoom: int) -> Column:
    return F.lit(2 * math.pi * MERCATOR_M) * F.cos(F.radians(lat)) / float(256 * 2**zoom)


def allowance_m(accuracy: Column) -> Column:
    """Distance at which a position still counts as being there."""
    return F.lit(600.0) + F.least(F.coalesce(accuracy, F.lit(0.0)), F.lit(300.0))
