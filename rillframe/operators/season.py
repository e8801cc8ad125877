"""Seasonal limits and reference rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_day(ts: Column) -> Column:
    """MM-dd text; unparsable or null input gives null."""
    return F.date_format(ts, "MM-dd")


def in_season(md: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends; a season that ends before it starts wraps over the new year; null without a season."""
    plain = (md >= start) & (md <= end)
    wrapped = (md >= start) | (md <= end)
    return F.when(start.isNull() | end.isNull() | md.isNull(), F.lit(None).cast("boolean")).when(start <= end, plain).otherwise(wrapped)


def reference_rate(capacity: Column, capacity_ok: Column, effective: Column, flood: Column, nonflood: Column, season: Column) -> Column:
    """capacity / (effective - flood control) * 100, or null.

    The flood-control figure of the season counts; where both are equal no season is
    needed.  Null when the capacity is no ok measurement, a number is missing, the season
    is needed but unknown, or the denominator isn't positive.  Never clamped.
    """
    control = F.when(flood == nonflood, flood).when(season, flood).when(~season, nonflood)
    denominator = F.when(flood.isNotNull() & nonflood.isNotNull(), effective - control)
    return F.when(capacity_ok & (denominator > 0), F.try_divide(capacity, denominator) * 100)


def adopt(official_status: Column, calculated: Column) -> Column:
    """A calculated figure counts only where the official one isn't ok."""
    return F.when(official_status != "ok", calculated)
