"""Rule tables: the quality gate, its classes, evidence groups, release states, areas and zooms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gate's limits, in percent but for the count of crossings.
LIMITS = {
    "area_error_pct": 15.0,
    "grid_drift_pct": 15.0,
    "unreached_pct": 10.0,
    "mask_far_outside_pct": 2.0,
    "ring_far_only_pct": 5.0,
    "path_outside_pct": 2.0,
    "ring_self_intersections": 0.0,
    "mask_largest_pct": 95.0,
    "fine_recompute_pct": 1.0,
    "reference_pct": 15.0,
}
#: Codes that mean broken data rather than a doubtful result.
INTEGRITY = ("fine_recompute_mismatch", "dem_edge", "dem_nodata_adjacent", "dem_unverified_empty_tile", "dem_missing_tile")


#: Reasons that are given once for each tile, and the measure that counts the tiles.
TILES = {"dem_unverified_empty_tile": "legacy_empty_tiles", "dem_missing_tile": "missing_tiles"}


def _over(value: Column, limit: float) -> Column:
    return F.abs(value) > limit


def checks(m: dict[str, Column]) -> list[tuple[str, str, Column, Column | None, float | None]]:
    """(code, severity, condition, value, limit) in the order the reasons are listed; a missing figure fires nothing."""
    top = LIMITS
    return [
        ("manual_hold", "block", m["hold"].isNotNull(), None, None),
        ("area_error", "block", _over(m["area_error_pct"], top["area_error_pct"]), m["area_error_pct"], top["area_error_pct"]),
        ("grid_drift", "block", _over(m["grid_drift_pct"], top["grid_drift_pct"]), m["grid_drift_pct"], top["grid_drift_pct"]),
        ("unreached", "block", m["unreached_pct"] > top["unreached_pct"], m["unreached_pct"], top["unreached_pct"]),
        ("rain_outside_ring", "block", m["mask_far_outside_pct"] > top["mask_far_outside_pct"], m["mask_far_outside_pct"], top["mask_far_outside_pct"]),
        ("ring_without_rain", "block", m["ring_far_only_pct"] > top["ring_far_only_pct"], m["ring_far_only_pct"], top["ring_far_only_pct"]),
        ("path_leaves_ring", "block", m["path_outside_pct"] > top["path_outside_pct"], m["path_outside_pct"], top["path_outside_pct"]),
        ("ring_self_intersects", "block", m["ring_self_intersections"] > top["ring_self_intersections"], m["ring_self_intersections"], top["ring_self_intersections"]),
        ("mask_fragmented", "block", m["mask_largest_pct"] < top["mask_largest_pct"], m["mask_largest_pct"], top["mask_largest_pct"]),
        ("dem_edge", "block", m["touches_edge"], None, None),
        ("dem_nodata_adjacent", "block", m["nodata_adjacent"] > 0, m["nodata_adjacent"], 0.0),
        ("dem_unverified_empty_tile", "block", m["legacy_empty_tiles"] > 0, None, None),
        ("dem_missing_tile", "block", m["missing_tiles"] > 0, None, None),
        ("no_official_direct_area", "warn", m["official_area"].isNull(), None, None),
        ("diversion_unknown", "warn", m["diversion"] == "unknown", None, None),
        ("diversion_yes", "warn", m["diversion"] == "yes", None, None),
        ("no_reservoir_surface", "warn", m["outlet_method"].startswith("snap"), None, None),
        ("fine_recompute_mismatch", "block", _over(m["fine_recompute_pct"], top["fine_recompute_pct"]), m["fine_recompute_pct"], top["fine_recompute_pct"]),
    ]


def gate(measures: dict[str, Column]) -> Column:
    """STRUCT<status, reasons, block_codes, warn_codes>: strict comparisons, any blocking reason holds."""
    none = F.lit(None).cast("double")
    fired = [
        F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                              (none if value is None else value.cast("double")).alias("value"), (none if limit is None else F.lit(limit)).alias("limit")))
        for code, severity, when, value, limit in checks(measures)
    ]
    # a reason for every tile, as each has to be looked at
    each = [
        F.array_repeat(f, F.greatest(F.lit(1), F.coalesce(measures[TILES[code]].cast("int"), F.lit(1)))) if code in TILES else F.array(f)
        for f, (code, *_) in zip(fired, checks(measures))]
    reasons = F.filter(F.concat(*each), lambda x: x.isNotNull())
    of = lambda kind: F.transform(F.filter(reasons, lambda x: x["severity"] == kind), lambda x: x["code"])
    return F.struct(F.when(F.size(of("block")) > 0, "hold").otherwise("pass").alias("status"), reasons.alias("reasons"),
                    of("block").alias("block_codes"), of("warn").alias("warn_codes"))


def qa_class(failed: Column, block_codes: Column, warn_codes: Column) -> Column:
    """UNEVALUABLE, FAIL (an integrity code), HOLD (another block), WARN or PASS."""
    broken = F.arrays_overlap(block_codes, F.array(*map(F.lit, INTEGRITY)))
    return (F.when(failed, "UNEVALUABLE").when(broken, "FAIL").when(F.size(block_codes) > 0, "HOLD")
            .when(F.size(warn_codes) > 0, "WARN").otherwise("PASS"))


def material(official: Column, reference: Column, reference_error: Column) -> Column:
    """What an area can be verified with."""
    return (F.when(official.isNotNull(), "official").when(reference.isNull(), "no_material")
            .when(F.abs(reference_error) <= LIMITS["reference_pct"], "ref_ok").otherwise("ref_divergent"))


def needs_human(cls: Column, of: Column) -> Column:
    return cls.isin("HOLD", "FAIL", "UNEVALUABLE") | ((cls == "WARN") & of.isin("ref_divergent", "no_material"))


def evidence_group(cls: Column, official: Column, diverted: Column, reference_error: Column) -> Column:
    """G1 official area, G2 official with water from elsewhere, G3 reference agrees, G4 anything else or not passed."""
    return (F.when(~cls.isin("PASS", "WARN"), "G4").when(official.isNotNull() & (diverted == "yes"), "G2").when(official.isNotNull(), "G1")
            .when(F.abs(reference_error) <= LIMITS["reference_pct"], "G3").otherwise("G4"))


def group_reason(cls: Column, official: Column, reference: Column, reference_error: Column) -> Column:
    """Why a product is in G4; null elsewhere."""
    return (F.when(~cls.isin("PASS", "WARN"), "qa_not_passed").when(official.isNotNull(), None)
            .when(reference.isNull() | reference_error.isNull(), "no_verification_material")
            .when(F.abs(reference_error) > LIMITS["reference_pct"], "reference_divergent"))


def released(tag: Column, status: Column, qa: Column, method: Column, wanted: str) -> Column:
    """Whether an entry of a public index may be shown: the index's tag, and approved, passed and exact."""
    return F.coalesce((tag == wanted) & (status == "approved") & (qa == "pass") & (method == "exact"), F.lit(False))


def official_area(direct: Column, total: Column) -> Column:
    """The direct area, else the whole."""
    return F.coalesce(direct, total)


def sizing_area(direct: Column, total: Column, reference: Column) -> Column:
    """What a window is sized by: the whole, the official or the reference area; zero counts as none."""
    some = lambda c: F.when(c != 0, c)
    return F.coalesce(some(total), some(official_area(direct, total)), some(reference))


def release_status(held: Column, method: Column, approved_version: Column, version: Column) -> Column:
    """held > not_exact > unapproved > stale > approved."""
    return (F.when(held, "held").when(~method.eqNullSafe("exact"), "not_exact").when(approved_version.isNull(), "unapproved")
            .when(~approved_version.eqNullSafe(version), "stale").otherwise("approved"))


def diversion(raw: Column, confirmed: Column, all_direct: Column, direct: Column, indirect: Column, total: Column) -> Column:
    """yes, none or unknown.

    Where the published text is there, any indirect figure means yes; where only numbers
    are confirmed, a positive one does, and zero or direct = total means none.
    """
    from_text = F.when(all_direct == 1, "none").when(indirect.isNotNull(), "yes").otherwise("unknown")
    from_numbers = F.when(indirect > 0, "yes").when((indirect == 0) | (direct == total), "none").otherwise("unknown")
    has_text = F.coalesce(raw, F.lit("")) != ""
    return F.when(has_text, from_text).when(confirmed, from_numbers).otherwise("unknown")


def zoom(area_km2: Column) -> Column:
    """Zoom level for a catchment's size; null and zero count as 30 km2."""
    a = sized(area_km2)
    return F.when(a < 30, 14).when(a < 150, 13).otherwise(12)


def sized(area_km2: Column) -> Column:
    return F.when(F.coalesce(area_km2, F.lit(0.0)) == 0, 30.0).otherwise(area_km2)


def pad(area_km2: Column) -> Column:
    """Tiles on each side of the centre tile: half of 2.6 * sqrt(area) + 3 km, at 36.6 degrees."""
    side = F.lit(2.6) * F.sqrt(sized(area_km2)) + 3.0
    tile_km = F.lit(2 * math.pi * 6378137 * math.cos(math.radians(36.6)) / 1000) / F.pow(F.lit(2.0), zoom(area_km2))
    return F.greatest(F.lit(1), F.ceil(side / tile_km / 2)).cast("int")


def freshness(age_days: Column, notice: int = 7, warn: int = 14) -> Column:
    """fresh, notice or warn by age in days; null age is unknown."""
    return F.when(age_days.isNull(), "unknown").when(age_days >= warn, "warn").when(age_days >= notice, "notice").otherwise("fresh")
