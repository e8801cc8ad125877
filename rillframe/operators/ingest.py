"""The refresh of observations as one DataFrame program: registry, masters and the newest slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.functions import text
from rillframe.operators import measure, relate, season

#: The six figures of a record, and the seconds a slot may be old.
FIGURES = ("rate_irrigation", "rate_effective", "level_m", "storage", "inflow", "outflow")
SLOT_AGE_S = 50 * 60
#: The source whose registry rows have stations.
STATIONS = "stations"


def season_of(level: Column, start: Column, end: Column) -> Column:
    """STRUCT<level, start_md, end_md>, or null where the level or a readable day is lacking; years count for nothing."""
    md = lambda c: F.date_format(F.try_to_timestamp(c, F.lit(text.OBSERVED)), "MM-dd")
    whole = level.isNotNull() & md(start).isNotNull() & md(end).isNotNull()
    return F.when(whole, F.struct(level.alias("level"), md(start).alias("start_md"), md(end).alias("end_md")))


def gated(registry: DataFrame, areas: DataFrame) -> DataFrame:
    """Registry rows of the areas whose source has stations; an unregistered area is never read."""
    return registry.join(areas.where(F.col("rate_source") == STATIONS).select("pref"), "pref", "left_semi")


def missing_masters(registry: DataFrame, masters: DataFrame) -> DataFrame:
    """Station codes without a cached master: what has to be fetched."""
    return registry.select("code").distinct().join(masters.select("code"), "code", "left_anti")


def records(registry: DataFrame, slugs: DataFrame, masters: DataFrame, slots: DataFrame, asked: Column) -> DataFrame:
    """A record a station: id, master, figures of the newest slot, status, season.

    ``registry`` has pref, name, code; ``slugs`` name, slug; ``masters`` code, office, limit_m,
    season_from, season_to; ``slots`` code, ts and a raw value and code of each figure.  A
    station without a slot in time has failed: both rates say so, its other figures are null.
    """
    rows = relate.with_dimension(registry, slugs, ["name"]).join(masters, "code", "left")
    newest = relate.asof(rows.withColumn("asked", asked), slots.withColumn("slot_ts", F.col("ts")), "code", "asked", "ts", ["slot_ts", *[f"{f}_{x}" for f in FIGURES for x in ("raw", "code")]], SLOT_AGE_S)
    came = F.col("slot_ts").isNotNull()
    failed = measure.failed("fetch_failed", "no slot in time")
    none = F.lit(None).cast("struct<value:double,status:string,reason:string>")
    figure = lambda f: F.when(came, measure.normalize(f"{f}_raw", f"{f}_code")).otherwise(failed if f.startswith("rate") else none).alias(f)
    out = newest.select("pref", "name", text.slug_id(F.col("pref"), F.col("slug"), F.col("code")).alias("dam_id"), "office", F.col("slot_ts").alias("obs_time"),
                        season_of(F.col("limit_m"), F.col("season_from"), F.col("season_to")).alias("season"), *[figure(f) for f in FIGURES])
    status = measure.record_status(F.col("rate_irrigation.status"), F.col("rate_effective.status"))
    inside = season.in_season(season.month_day(F.col("obs_time")), F.col("season.start_md"), F.col("season.end_md"))
    return out.withColumn("data_status", status).withColumn("in_season", inside)


def unsourced(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    """Records of dams without any source (pref, name, reason): all six figures say why."""
    blank = measure.failed("no_source", F.trim("reason"))
    return relate.with_dimension(rows, slugs, ["name"]).select(
        "pref", "name", text.slug_id(F.col("pref"), F.col("slug"), F.col("name")).alias("dam_id"), *[blank.alias(f) for f in FIGURES], F.lit("no_source").alias("data_status"))


def refresh(registry: DataFrame, areas: DataFrame, slugs: DataFrame, masters: DataFrame, slots: DataFrame, without: DataFrame | None, asked: Column) -> DataFrame:
    """All records; ``without`` are the dams that have no source, None leaves them out."""
    out = records(gated(registry, areas), slugs, masters, slots, asked)
    return out if without is None else out.unionByName(unsourced(without, slugs), allowMissingColumns=True)
