"""Rings, containment and distance joins.

Distance and containment joins carry an explicit cell key: the candidate side is spread
over the cells it can reach and the plan is an equi join, so neither side has to be
broadcast and no cross product is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions import geo


def ring_edges(vertices: DataFrame, ring: str, order: list[str], x: str, y: str) -> DataFrame:
    """(ring, i, x1, y1, x2, y2): consecutive vertices, the last joined to the first."""
    w = Window.partitionBy(ring).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(ring, (F.row_number().over(w) - 1).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"), nxt(x).alias("x2"), nxt(y).alias("y2"),
                           F.count("*").over(whole).alias("n"))


def crosses(px: Column, py: Column) -> Column:
    """Whether a ray to the east from the point crosses the edge x1,y1 - x2,y2: even-odd rule, half-open in y."""
    return ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))


def folded(points: DataFrame, key: str, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of every key, and the points (key, *at) of the representatives alone.

    Keys whose rows lie at the same places have the same rep, so what depends on places
    alone is worked out once for all of them.
    """
    places = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*at))).alias("at_"))
    reps = places.groupBy("at_").agg(F.min(key).alias("rep"))
    return places.join(reps, "at_").select(key, "rep"), reps.select(F.col("rep").alias(key), F.explode("at_").alias("p")).select(key, *[f"p.{c}" for c in at])


def unfolded(rows: DataFrame, who: DataFrame, key: str) -> DataFrame:
    """``rows`` of the representatives as rows of every key that each stands for."""
    rest = [c for c in rows.columns if c != key]
    return who.join(rows.withColumnRenamed(key, "rep_"), F.col("rep").eqNullSafe(F.col("rep_"))).select(key, *rest)


def points_in_rings(points: DataFrame, edges: DataFrame, ring: str, key: str, px: str, py: str, bands: float = 10.0) -> DataFrame:
    """(key, ring) of the points inside each ring.

    Edges are spread over horizontal bands of 1/bands degrees and meet the points of the
    band, so only edges that a point's ray can cross are joined; points at one place meet
    them once.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(low * bands), F.floor(high * bands))))
    who, reps = folded(points, key, [px, py])
    at = reps.withColumn("band", F.floor(F.col(py) * bands))
    inside = (at.join(spread, "band").where(crosses(F.col(px), F.col(py))).groupBy(key, ring).agg(F.count("*").alias("hits"))
              .where("hits % 2 = 1").select(key, ring))
    return unfolded(inside, who, key)


def within_km(left: DataFrame, right: DataFrame, km: float, left_key: str, right_key: str) -> DataFrame:
    """Pairs within a flat radius; both sides have lat and lon.

    Cells are as tall and wide as the radius, so a partner lies in one of nine cells.
    """
    tall, wide = km / 111.0, km / 91.0
    cell = lambda c, size: F.floor(F.col(c) / size)
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(left_key, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(near).alias("d")).select(
        left_key, "lat1", "lon1", (F.floor(F.col("lat1") / tall) + F.col("d.di")).alias("ci"), (F.floor(F.col("lon1") / wide) + F.col("d.dj")).alias("cj"))
    b = right.select(right_key, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell("lat", tall).alias("ci"), cell("lon", wide).alias("cj"))
    d = geo.flat_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["ci", "cj"]).withColumn("km", d).where(F.col("km") <= km).select(left_key, right_key, "km")


def with_finer(radii_km: tuple[float, ...], places: DataFrame, lat: str, lon: str, most: int = 16) -> tuple[float, ...]:
    """The radii, after finer ones if a square of the first radius holds more than ``most`` places (counted by a job), each a quarter of the next."""
    square = lambda c: F.floor(F.col(c) / (radii_km[0] / 111.0))
    densest = places.groupBy(square(lat).alias("i"), square(lon).alias("j")).count().agg(F.max("count")).first()[0] or 0
    finer, km = [], radii_km[0]
    while densest > most:
        km, densest = km / 4, densest / 16
        finer.insert(0, km)
    return (*finer, *radii_km)


def nearest_k(left: DataFrame, right: DataFrame, k: int, left_key: str, right_key: str, radii_km: tuple[float, ...] = (5.0, 15.0, 45.0), digits: int = 6) -> DataFrame:
    """(left_key, right_key, km, rank): the k nearest right rows below the last radius, ties (to ``digits`` decimals) to the smaller key.

    A row with k partners within a radius is done; only the others look further, so a
    dense place never meets all that lies within the last radius.  Left rows at one place
    look once, and of right rows at one place the first k take part.
    """
    order = Window.partitionBy(left_key).orderBy(F.round("km", digits), right_key)
    here = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(right_key))
    right = right.select(right_key, "lat", "lon").withColumn("here", here).where(F.col("here") <= k).drop("here")
    who, rest = folded(left, left_key, ["lat", "lon"])
    out, radii_km = None, with_finer(radii_km, right, "lat", "lon", 16 * k)
    for n, km in enumerate(radii_km):
        near = within_km(rest, right, km, left_key, right_key).where(F.col("km") < km)
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if n < len(radii_km) - 1:
            done = ranked.where(F.col("rank") == k).select(left_key)
            ranked = ranked.join(done, left_key, "left_semi")
            rest = rest.join(done, left_key, "left_anti")
        out = ranked if out is None else out.unionByName(ranked)
    return unfolded(out, who, left_key)


def containing_others(points: DataFrame, edges: DataFrame, areas: DataFrame, key: str, ring: str, px: str, py: str) -> DataFrame:
    """(key, ring, place): the rings of others that hold a point, by area, then key; a point's own ring is left out."""
    inside = points_in_rings(points, edges, ring, key, px, py).where(F.col(key) != F.col(ring)).join(areas, ring)
    return inside.select(key, ring, F.row_number().over(Window.partitionBy(key).orderBy("area", ring)).alias("place"))


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radii_km: tuple[float, ...] = (5.0, 40.0), lat_most: float = 60.0,
            digits: int = 3) -> DataFrame:
    """(left_key, right_key, metres): the nearest right row of every left row, ties (to ``digits`` decimals) to the smaller key.

    Places meet in cells that are wide enough for a radius up to ``lat_most`` and go round
    the globe, so places on both sides of the date line are neighbours; a nearest place within the radius is final, the others try the next radius, and what is left
    (remote places, or nearer to a pole) is compared with all of the right side.  Left rows
    at one place look once, and of right rows at one place the smallest key takes part.
    """
    who, a = folded(left.select(left_key, F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), left_key, ["lat1", "lon1"])
    b = right.groupBy(F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).agg(F.min(right_key).alias(right_key))
    metres = F.round(geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), digits)
    pick = lambda pairs: pairs.groupBy(left_key).agg(F.min(F.struct(metres.alias("m"), F.col(right_key).alias("k"))).alias("b")).select(
        left_key, F.col("b.k").alias(right_key), F.col("b.m").alias("metres"))
    around = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out, rest = None, a
    for km in with_finer(radii_km, b, "lat2", "lon2"):
        tall = 1.02 * km / (geo.EARTH_M / 1000 * math.pi / 180)
        around_globe = int(360 * math.cos(math.radians(lat_most)) / tall)
        wide = 360 / around_globe
        column = lambda c: F.floor((F.col(c) + 180.0) / wide)
        spread = rest.where(F.abs("lat1") < lat_most - tall).select("*", F.explode(around).alias("d")).select(
            left_key, "lat1", "lon1", (F.floor(F.col("lat1") / tall) + F.col("d.di")).alias("ci"), F.pmod(column("lon1") + F.col("d.dj"), F.lit(around_globe)).alias("cj"))
        cells = b.select("*", F.floor(F.col("lat2") / tall).alias("ci"), F.pmod(column("lon2"), F.lit(around_globe)).alias("cj"))
        found = pick(spread.join(cells, ["ci", "cj"])).where(F.col("metres") <= km * 1000)
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select(left_key), left_key, "left_anti")
    return unfolded(out.unionByName(pick(rest.crossJoin(b))), who, left_key)


def self_intersections(edges: DataFrame, ring: str) -> DataFrame:
    """(ring, crossings): proper crossings of edges that aren't neighbours."""
    turn = lambda a, b, c: ((F.col(f"{b[0]}") - F.col(f"{a[0]}")) * (F.col(f"{c[1]}") - F.col(f"{a[1]}"))
                            - (F.col(f"{b[1]}") - F.col(f"{a[1]}")) * (F.col(f"{c[0]}") - F.col(f"{a[0]}")))
    e = edges.select(ring, "i", "n", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    f = edges.select(ring, F.col("i").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q, r, s = ("ax1", "ay1"), ("ax2", "ay2"), ("bx1", "by1"), ("bx2", "by2")
    cross = (turn(p, q, r) * turn(p, q, s) < 0) & (turn(r, s, p) * turn(r, s, q) < 0)
    both = e.join(f, ring).where((F.col("i") + 2 <= F.col("j")) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 1)))
    return edges.select(ring).distinct().join(both.where(cross).groupBy(ring).agg(F.count("*").alias("crossings")), ring, "left").select(
        ring, F.coalesce("crossings", F.lit(0)).alias("crossings"))


def position_at(points: DataFrame, path: str, pos: str, distance: Column) -> DataFrame:
    """(path, x, y): the place ``distance`` along each path of points, straight between them, the last one beyond the end.

    ``distance`` may use the path's key.  Only the stretch that holds the distance is kept.
    """
    w = Window.partitionBy(path).orderBy(pos)
    step = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = points.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("step", step)
    rows = rows.withColumn("gone", F.coalesce(F.sum("step").over(before), F.lit(0.0))).withColumn("want", distance).where("gone <= want")
    part = F.when(F.col("nx").isNull() | (F.col("step") == 0), 0.0).otherwise(F.least((F.col("want") - F.col("gone")) / F.col("step"), F.lit(1.0)))
    at = lambda c: (F.col(c) + (F.coalesce(F.col("n" + c), F.col(c)) - F.col(c)) * part).alias(c)
    return rows.groupBy(path).agg(F.max_by(F.struct(at("x"), at("y")), pos).alias("p")).select(path, "p.x", "p.y")


def spikes(edges: DataFrame, ring: str, cosine: float = 0.87) -> DataFrame:
    """Edges with whether the corner at their start is so sharp that its cosine reaches ``cosine``; rings close."""
    w = Window.partitionBy(ring).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) - F.col(c)
    ux, uy, vx, vy = back("x1"), back("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cos = F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy))
    return edges.withColumn("spike", F.coalesce(cos >= cosine, F.lit(False)))
