"""Visit logs: backup files, their validation and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators import relate

#: The backup's tag and the newest format this version reads.
TAG, FORMAT = "visit-backup", 1
#: Fields that a backup must not carry: exact positions and distances.
FORBIDDEN = ("lat", "lon", "latitude", "longitude", "distance_m")

BACKUP = "tag string, format int, visits array<map<string, string>>"


def validate(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files (path, body).

    A file is rejected as a whole for unreadable JSON, another tag, a newer format, no
    list of visits or a forbidden field; a single visit without a dam or with an
    unreadable date is skipped.
    """
    rows = files.withColumn("b", F.from_json("body", BACKUP))
    wrong = (F.when(F.col("b").isNull() | F.col("b.tag").isNull(), "unreadable").when(F.col("b.tag") != TAG, "other_file")
             .when(F.col("b.format").isNull() | (F.col("b.format") > FORMAT), "newer_format").when(F.col("b.visits").isNull(), "no_visits")
             .when(F.exists("b.visits", lambda v: F.arrays_overlap(F.map_keys(v), F.array(*map(F.lit, FORBIDDEN)))), "forbidden_field"))
    judged = rows.withColumn("why", wrong)
    each = judged.where("why is null").select("path", F.explode("b.visits").alias("v")).select(
        "path", F.try_element_at("v", F.lit("dam_id")).alias("dam_id"), F.try_to_timestamp(F.try_element_at("v", F.lit("visited_at"))).alias("visited_at"),
        F.try_element_at("v", F.lit("note")).alias("note"))
    return each.where("dam_id is not null and dam_id <> '' and visited_at is not null"), judged.where("why is not null").select("path", "why")


def merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One visit a dam: the earliest, as a whole record; a tie keeps the current one."""
    cols = ["dam_id", "visited_at", "note"]
    # of several incoming visits of one time the first note counts
    first = incoming.groupBy("dam_id").agg(F.min(F.struct(F.col("visited_at").isNull().alias("late"), "visited_at", "note")).alias("v")).select("dam_id", "v.visited_at", "v.note")
    return relate.earliest_wins(current.select(*cols), first.select(*cols), ["dam_id"], "visited_at")


def export(visits: DataFrame) -> DataFrame:
    """One row (body): the backup of a log, without positions and distances; a log is one person's."""
    entry = F.struct("dam_id", F.date_format("visited_at", "yyyy-MM-dd'T'HH:mm:ss").alias("visited_at"), "note")
    one = visits.agg(F.array_sort(F.collect_list(entry)).alias("visits"))
    return one.select(F.to_json(F.struct(F.lit(TAG).alias("tag"), F.lit(FORMAT).alias("format"), "visits")).alias("body"))


def newest_first(visits: DataFrame) -> DataFrame:
    """A log for reading: the latest visit first, those without a date last."""
    return visits.orderBy(F.desc_nulls_last("visited_at"), "dam_id")
