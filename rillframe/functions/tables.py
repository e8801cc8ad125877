"""Table functions: traces on packed flow grids, tiles around a place."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos int, i int, j int, travelled double")
class D8Trace:
    """Cells from (i, j) down a packed direction grid, with the distance in cells; at most ``most`` steps.

    A code above 7 or the edge of the grid ends the way; a null argument gives no rows.
    """

    def eval(self, d8: bytes, h: int, w: int, i: int, j: int, most: int = 200_000) -> Iterator[tuple]:
        from rillframe.kernels.terrain import way_down

        if None not in (d8, h, w, i, j):
            yield from way_down(d8, h, w, i, j, most)


@udtf(returnType="x int, y int")
class TilesAround:
    """The (2 pad + 1)^2 tiles around a place, row by row."""

    def eval(self, lat: float, lon: float, zoom: int, pad: int) -> Iterator[tuple]:
        from rillframe.kernels.tiles import xy

        if None in (lat, lon, zoom, pad):
            return
        cx, cy = (int(v) for v in xy(lat, lon, zoom))
        for dy in range(-pad, pad + 1):
            for dx in range(-pad, pad + 1):
                yield cx + dx, cy + dy


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as d8_trace and tiles_around."""
    spark.udtf.register("d8_trace", D8Trace)
    spark.udtf.register("tiles_around", TilesAround)
