"""Measurement triples {value, status, reason}: a number is never imputed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quality codes that decide a measurement's status.
CODE_CLOSED = 140
CODE_MISSING = 190
CODE_NOT_PROVIDED_FROM = 130

REASONS = {"missing": "no reading in this slot", "closed": "station closed", "not_provided": "not provided by the source"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_of(raw: Column | str, code: Column | str) -> Column:
    """Ordered rules; a missing code outranks a raw value that is present."""
    raw, code = _col(raw), _col(code)
    return (
        F.when(code == CODE_MISSING, "missing")
        .when(code == CODE_CLOSED, "closed")
        .when(code.isNull() | (code >= CODE_NOT_PROVIDED_FROM), "not_provided")
        .when(raw.isNull(), "missing")
        .otherwise("ok")
    )


def normalize(raw: Column | str, code: Column | str) -> Column:
    """STRUCT<value, status, reason>; value is null unless status is ok."""
    status = status_of(raw, code)
    reason = F.lit(None).cast("string")
    for name, text in REASONS.items():
        reason = F.when(status == name, text).otherwise(reason)
    return F.struct(
        F.when(status == "ok", _col(raw).cast("double")).alias("value"), status.alias("status"), reason.alias("reason"),
    )


def failed(status: str, reason: Column | str) -> Column:
    """The measurement of a source that could not be read or does not exist."""
    return F.struct(F.lit(None).cast("double").alias("value"), F.lit(status).alias("status"),
                    (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def value_of(m: str) -> Column:
    """The number of an ok measurement, without NaN."""
    v = F.col(f"{m}.value")
    return F.when((F.col(f"{m}.status") == "ok") & ~F.isnan(v), v)


def record_status(first: Column, second: Column) -> Column:
    """Both ok, one ok, or the first one's own status."""
    return (
        F.when((first == "ok") & (second == "ok"), "ok")
        .when((first == "ok") | (second == "ok"), "partial")
        .otherwise(first)
    )


def coverage_class(status: Column, calculated_ok: Column) -> Column:
    """An official figure wins; a calculated one is shown only in its absence."""
    return F.when(status == "ok", "official").when(calculated_ok, "reference").otherwise("none")


def bin_index(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge, next) holding the value, 0 below all edges; null stays null."""
    out = F.lit(0)
    for i, edge in enumerate(sorted(edges), 1):
        out = F.when(value >= edge, i).otherwise(out)
    return F.when(value.isNotNull(), out)


def shown(basis: Column, official: Column, calculated: Column, effective: Column) -> Column:
    """STRUCT<value, calculated>: by irrigation the official figure, else the calculated one; by any other basis the effective one alone."""
    irrigation = basis == "irrigation"
    return F.struct(F.when(irrigation, F.coalesce(official, calculated)).otherwise(effective).alias("value"),
                    (irrigation & official.isNull() & calculated.isNotNull()).alias("calculated"))


def colour(value: Column, bins: list[tuple[float, str]], none: str) -> Column:
    """Colour of the bin that begins at or below the value; ``none`` without a value or below all bins."""
    out = F.lit(none)
    for low, name in sorted(bins):
        out = F.when(value >= low, name).otherwise(out)
    return out
