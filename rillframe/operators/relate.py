"""Keyed relations: dimension joins, audits, overwrites, as-of look-ups, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_dimension(rows: DataFrame, dimension: DataFrame, on: list[str], **defaults: object) -> DataFrame:
    """Left join; missing columns of the dimension take the defaults.  The size of the dimension decides the strategy."""
    out = rows.join(dimension, on, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value if isinstance(value, Column) else F.lit(value)))
    return out


def unknown_keys(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't registered: the violations of a reference."""
    return rows.join(known.select(*on), on, "left_anti")


def audit(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """Full outer comparison by key: only_left, only_right, changed or same."""
    both = left.select(key, left_value, F.lit(True).alias("in_left")).join(
        right.select(key, right_value, F.lit(True).alias("in_right")), key, "full_outer")
    state = (F.when(F.col("in_right").isNull(), "only_left").when(F.col("in_left").isNull(), "only_right")
             .when(F.col(left_value).eqNullSafe(F.col(right_value)), "same").otherwise("changed"))
    return both.select(key, left_value, right_value, state.alias("state"))


def overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: the new row replaces the old as a whole; keys of either side stay."""
    values = [c for c in old.columns if c != key]
    n = new.select(key, F.struct(*values).alias("n"))
    o = old.select(key, F.struct(*values).alias("o"))
    return o.join(n, key, "full_outer").select(key, *[F.when(F.col("n").isNotNull(), F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values])


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, payload: list[str], tolerance_s: int) -> DataFrame:
    """Backward as-of: the newest right row at or before the left time and within the tolerance.

    Both sides go through one shuffle on the key: the rows are unioned, and the last right
    row is carried forward.  A hot key costs a window partition; no pair is built.  Right
    rows of one time are ordered by payload and the largest is taken.
    """
    carried = F.struct(F.col(right_ts).alias("ts"), *payload)
    kind = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    r = right.select(by, F.col(right_ts).alias("t"), F.lit(0).alias("side"), carried.alias("r"), F.lit(None).cast(kind).alias("l"))
    lft = left.select(by, F.col(left_ts).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(r.schema["r"].dataType).alias("r"), F.struct(*left.columns).alias("l"))
    w = Window.partitionBy(by).orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lft).withColumn("last", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    near = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("last.ts").cast("timestamp")) <= tolerance_s * 1_000_000
    return both.select("l.*", *[F.when(near, F.col(f"last.{c}")).alias(c) for c in payload])


def earliest_wins(current: DataFrame, incoming: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Union by key: the whole record with the earliest time; a tie or two unknown times keep the current one."""
    both = current.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(ts), "side")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "side")
