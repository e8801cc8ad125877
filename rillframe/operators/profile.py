"""Outlet profiles: the strongest cells around a dam, and the area along the way down.

The cells around a dam are aggregated once by the smallest radius that holds them and a
running maximum over the radii follows; the way down is a table function on the packed
directions.  A dam is a partition of its own key throughout, so many dams run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Radii of a profile, the radius from which the walk starts, length of the walk and distance of its entries, in metres.
RADII_M, START_M, WALK_M, EVERY_M = (50, 150, 250, 400, 700, 1000), 150, 3000.0, 250.0
#: Cells of a radius at least.
LEAST_CELLS = 3


def strongest_within(dams: DataFrame, cells: DataFrame) -> DataFrame:
    """(dam_id, radius_m, i, j, acc, away_m): the cell of the largest accumulation in the square of each radius, ties row by row.

    ``dams`` has dam_id, oi, oj, mpp and ``cells`` dam_id, i, j, acc.
    """
    near = F.greatest(F.abs(F.col("i") - F.col("oi")), F.abs(F.col("j") - F.col("oj")))
    place = F.lit(None).cast("int")
    for k, radius in reversed(list(enumerate(RADII_M))):
        place = F.when(near <= F.greatest(F.lit(LEAST_CELLS), F.floor(F.lit(float(radius)) / F.col("mpp"))), k).otherwise(place)
    best = F.max(F.struct("acc", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj")))
    ringed = cells.join(dams, "dam_id").withColumn("k", place).where("k is not null").groupBy("dam_id", "oi", "oj", "mpp", "k").agg(best.alias("b"))
    # a radius without cells of its own takes over the smaller one's
    every = ringed.groupBy("dam_id", "oi", "oj", "mpp").agg(*[F.max(F.when(F.col("k") <= k, F.col("b"))).alias(f"b{k}") for k in range(len(RADII_M))])
    rows = every.select("dam_id", "oi", "oj", "mpp", F.explode(F.array(*[F.struct(F.lit(r).alias("radius_m"), F.col(f"b{k}").alias("b")) for k, r in enumerate(RADII_M)])).alias("r"))
    i, j = -F.col("r.b.ni"), -F.col("r.b.nj")
    away = F.hypot((i - F.col("oi")).cast("double"), (j - F.col("oj")).cast("double")) * F.col("mpp")
    return rows.where("r.b is not null").select("dam_id", F.col("r.radius_m").alias("radius_m"), i.alias("i"), j.alias("j"), F.col("r.b.acc").alias("acc"), away.alias("away_m"))


def _walk(batches) -> Iterator:
    """(dam_id, d8, h, w, i, j, mpp) to an entry each EVERY_M along the way down, one a step at most."""
    import pyarrow as pa

    from rillframe.kernels.terrain import way_down

    for batch in batches:
        out = []
        for dam, d8, h, w, i, j, mpp in zip(*(c.to_pylist() for c in batch.columns)):
            entries = 0
            for _, ci, cj, cells in way_down(d8, h, w, i, j, h * w):
                metres = cells * mpp
                if metres > WALK_M:
                    break
                if metres >= entries * EVERY_M:
                    out.append((dam, entries, ci, cj, metres))
                    entries += 1
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["dam_id", "n", "i", "j", "travelled_m"])


def downstream(dams: DataFrame, grids: DataFrame, cells: DataFrame) -> DataFrame:
    """(dam_id, n, travelled_m, acc): accumulation along the way down from the strongest cell within START_M.

    ``grids`` has dam_id, d8, h, w.
    """
    start = strongest_within(dams, cells).where(F.col("radius_m") == START_M).select("dam_id", "i", "j")
    steps = grids.join(start, "dam_id").join(dams.select("dam_id", "mpp"), "dam_id").select(
        F.col("dam_id").cast("string"), "d8", F.col("h").cast("int"), F.col("w").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"), "mpp")
    walk = steps.mapInArrow(_walk, "dam_id string, n int, i int, j int, travelled_m double")
    return walk.join(cells.select(F.col("dam_id").cast("string").alias("dam_id"), "i", "j", "acc"), ["dam_id", "i", "j"]).select("dam_id", "n", "travelled_m", "acc")
