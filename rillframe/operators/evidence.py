"""What speaks for and against a product; recorded beside the gate, never part of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.functions import geo
from rillframe.functions.text import percent_error

#: Fixed value: degrees within which two places are one.
SAME_DEG = 1e-6


def coordinate(lat: Column, lon: Column, station_lat: Column, station_lon: Column) -> Column:
    """STRUCT<class, offset_m>: whether a dam stands at its station's place."""
    known = station_lat.isNotNull() & station_lon.isNotNull()
    same = (F.abs(station_lat - lat) < SAME_DEG) & (F.abs(station_lon - lon) < SAME_DEG)
    return F.struct(F.when(~known, "no_station").when(same, "identical").otherwise("differs").alias("class"),
                    F.when(known, F.round(geo.local_m(lat, lon, station_lat, station_lon), 1)).alias("offset_m"))


def lake_pct(method: Column, lake_km2: Column, catchment_km2: Column) -> Column:
    """Share of the water surface in the catchment, where one was found."""
    return F.when((method == "reservoir") & (catchment_km2 != 0), F.round(lake_km2 / catchment_km2 * 100, 3))


def spread(radii: Column, low: int, high: int) -> Column:
    """Largest over smallest area of the profile's radii (ARRAY<STRUCT<radius_m, km2>>) between two bounds."""
    some = F.transform(F.filter(radii, lambda r: r["radius_m"].between(low, high)), lambda r: r["km2"])
    return F.when((F.size(some) > 0) & (F.array_min(some) > 0), F.round(F.array_max(some) / F.array_min(some), 3))


def method_differences(method: Column, radii: Column, computed_km2: Column) -> Column:
    """Percent by which each river candidate differs from the reservoir's catchment; null for other methods."""
    return F.when(method == "reservoir", F.transform(radii, lambda r: percent_error(r["km2"], computed_km2)))


def judged(dams: DataFrame, rows: DataFrame, failures: DataFrame) -> DataFrame:
    """(dam_id, cls, why): of every dam its row, else its failure, else a failure for having neither."""
    both = dams.select("dam_id").join(rows.select("dam_id", "cls"), "dam_id", "left").join(failures.select("dam_id", "error"), "dam_id", "left")
    return both.select("dam_id", F.coalesce("cls", F.lit("UNEVALUABLE")).alias("cls"),
                       F.when(F.col("cls").isNull(), F.coalesce("error", F.lit("no result"))).alias("why"))


def totals(rows: DataFrame, by: str, registry: DataFrame, groups: tuple[str, ...] = ("G1", "G2", "G3", "G4")) -> DataFrame:
    """Rows of each group for every key of the registry and in all (a null key), zeros included; no key is made up."""
    count = lambda g: F.count_if(F.col("grp") == g).alias(g)
    keyed = registry.select(by).join(rows.groupBy(by).agg(*map(count, groups)), by, "left").select(by, *[F.coalesce(g, F.lit(0)).alias(g) for g in groups])
    whole = keyed.agg(*[F.sum(g).alias(g) for g in groups]).select(F.lit(None).cast(keyed.schema[by].dataType).alias(by), *groups)
    return reduce(DataFrame.unionByName, [keyed, whole])
