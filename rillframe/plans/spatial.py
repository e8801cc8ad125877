"""Distance, ring and tile queries; suppliers are stations, customers dams, nations catchments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.functions import geo
from rillframe.operators import spatial
from rillframe.plans.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(key, (F.lit(36.0) + (k * 37 % 1000) / 1000.0).alias("lat"), (F.lit(137.0) + (k * 91 % 1000) / 1000.0).alias("lon"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of one ring a nation: its suppliers in a fixed order."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ring"), k.alias("v"), (F.lit(137.0) + (k * 91 % 1000) / 1000.0).alias("x"), (F.lit(36.0) + (k * 37 % 1000) / 1000.0).alias("y"))
    # a vertex's place in its ring comes from integers, so every engine sorts alike
    return rows.withColumn("o", F.col("v") * 7919 % 104729)


_RING_SQL = """pt AS (SELECT s_nationkey AS ring, s_suppkey AS v, 137.0::DOUBLE + (s_suppkey * 91 % 1000) / 1000.0::DOUBLE AS x, 36.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS y,
  s_suppkey * 7919 % 104729 AS o FROM supplier),
ed AS (SELECT ring, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ring) AS n, x AS x1, y AS y1,
  coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pt WINDOW w AS (PARTITION BY ring ORDER BY o, v))"""
_CUST_SQL = "c AS (SELECT c_custkey, 36.0::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 137.0::DOUBLE + (c_custkey * 91 % 1000) / 1000.0::DOUBLE AS lon FROM customer)"
_SUPP_SQL = "s AS (SELECT s_suppkey, 36.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 137.0::DOUBLE + (s_suppkey * 91 % 1000) / 1000.0::DOUBLE AS lon FROM supplier)"
_FLAT = "sqrt(pow((s.lat - c.lat) * 111.0::DOUBLE, 2) + pow((s.lon - c.lon) * 91.0::DOUBLE, 2))"


@query(f"""WITH {_CUST_SQL}, {_SUPP_SQL}, d AS (SELECT c_custkey, s_suppkey, 2 * 6371000 * asin(sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))) AS m FROM c, s)
SELECT c_custkey, s_suppkey, floor(round(m, 3))::BIGINT AS metres FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(m, 3), s_suppkey) AS rn FROM d) WHERE rn = 1""")
def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest station of every dam; distances within a millimetre are a tie."""
    out = spatial.nearest(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), "c_custkey", "s_suppkey")
    return out.select("c_custkey", "s_suppkey", F.floor("metres").cast("bigint").alias("metres"))


@query(f"""WITH {_CUST_SQL}, {_SUPP_SQL}, d AS (SELECT c_custkey, s_suppkey, {_FLAT} AS km FROM c, s WHERE {_FLAT} < 45)
SELECT c_custkey, s_suppkey, rank FROM (SELECT *, (row_number() OVER (PARTITION BY c_custkey ORDER BY round(km, 6), s_suppkey))::INTEGER AS rank FROM d) WHERE rank <= 3""")
def q_topk_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest stations below 45 kilometres."""
    near = spatial.nearest_k(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), 3, "c_custkey", "s_suppkey")
    return near.select("c_custkey", "s_suppkey", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {_RING_SQL}, {_CUST_SQL} SELECT c_custkey, ring FROM c JOIN ed ON y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def q_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which catchments hold which dams."""
    edges = spatial.ring_edges(_rings(spark, sf_dir), "ring", ["o", "v"], "x", "y")
    return spatial.points_in_rings(_points(spark, sf_dir, "customer", "c_custkey"), edges, "ring", "c_custkey", "lon", "lat")


@query(f"""WITH {_RING_SQL}, e AS (SELECT a.ring, ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0 AS hit
  FROM ed a JOIN ed b ON a.ring = b.ring AND a.i + 2 <= b.i AND NOT (a.i = 0 AND b.i = a.n - 1))
SELECT r.ring, coalesce(count(*) FILTER (hit), 0) AS crossings FROM (SELECT DISTINCT ring FROM ed) r LEFT JOIN e ON e.ring = r.ring GROUP BY 1""")
def q_ring_self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spatial.ring_edges(_rings(spark, sf_dir), "ring", ["o", "v"], "x", "y")
    return spatial.self_intersections(edges, "ring")


@query(f"""WITH {_RING_SQL} SELECT n_nationkey, coalesce(min(x), 136.0::DOUBLE) AS west, coalesce(max(x), 138.0::DOUBLE) AS east, coalesce(min(y), 35.0::DOUBLE) AS south, coalesce(max(y), 37.0::DOUBLE) AS north
FROM nation LEFT JOIN pt ON ring = n_nationkey GROUP BY 1""")
def q_ring_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes, with a default box for a ring without vertices."""
    boxes = _rings(spark, sf_dir).groupBy(F.col("ring").alias("n_nationkey")).agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "west"), (F.max, "x", "east"), (F.min, "y", "south"), (F.max, "y", "north"))])
    default = {"west": 136.0, "east": 138.0, "south": 35.0, "north": 37.0}
    return table(spark, sf_dir, "nation").select("n_nationkey").join(boxes, "n_nationkey", "left").select("n_nationkey", *[F.coalesce(n, F.lit(v)).alias(n) for n, v in default.items()])


@query(f"""WITH {_RING_SQL}, {_CUST_SQL}, {_SUPP_SQL}, inside AS (SELECT c_custkey, ring FROM c JOIN ed ON y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
area AS (SELECT ring, max(x) - min(x) AS a FROM pt GROUP BY 1), hit AS (SELECT c_custkey, ring AS target, row_number() OVER (PARTITION BY c_custkey ORDER BY a, ring) AS o FROM inside JOIN area USING (ring)),
near AS (SELECT c_custkey, s_nationkey AS target, 1000 + row_number() OVER (PARTITION BY c_custkey ORDER BY round({_FLAT}, 6), s.s_suppkey) AS o FROM c JOIN s ON {_FLAT} < 45 JOIN supplier USING (s_suppkey)),
u AS (SELECT c_custkey, target, min(o) AS o FROM (SELECT * FROM hit UNION ALL SELECT * FROM near WHERE o <= 1003) GROUP BY 1, 2)
SELECT c_custkey, arg_min(target, o) AS target, count(*) AS candidates FROM u GROUP BY 1""")
def q_tap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containing catchments by size, then the three nearest, without repeats: the first is the answer."""
    who, points = spatial.folded(_points(spark, sf_dir, "customer", "c_custkey"), "c_custkey", ["lat", "lon"])
    vertices = _rings(spark, sf_dir)
    inside = spatial.points_in_rings(points, spatial.ring_edges(vertices, "ring", ["o", "v"], "x", "y"), "ring", "c_custkey", "lon", "lat")
    area = vertices.groupBy("ring").agg((F.max("x") - F.min("x")).alias("a"))
    hit = inside.join(area, "ring").select("c_custkey", F.col("ring").alias("target"), F.row_number().over(Window.partitionBy("c_custkey").orderBy("a", "ring")).alias("o"))
    near = spatial.nearest_k(points, _points(spark, sf_dir, "supplier", "s_suppkey"), 3, "c_custkey", "s_suppkey").withColumn("o", F.col("rank") + 1000)
    near = near.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target")), "s_suppkey").select("c_custkey", "target", "o")
    ranked = hit.unionByName(near).groupBy("c_custkey", "target").agg(F.min("o").alias("o"))
    first = ranked.groupBy("c_custkey").agg(F.min(F.struct("o", "target")).alias("best"), F.count("*").alias("candidates")).select("c_custkey", F.col("best.target").alias("target"), "candidates")
    return spatial.unfolded(first, who, "c_custkey")


@query(f"""WITH {_CUST_SQL} SELECT c_custkey, floor((lon + 180) / 360 * 8192)::BIGINT + dx AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192)::BIGINT + dy AS y
FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)""")
def q_tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine elevation tiles around every dam."""
    points = _points(spark, sf_dir, "customer", "c_custkey")
    step = F.sequence(F.lit(-1), F.lit(1))
    rows = points.select("c_custkey", F.floor(geo.tile_x(F.col("lon"), 13)).alias("tx"), F.floor(geo.tile_y(F.col("lat"), 13)).alias("ty"), F.explode(step).alias("dx"))
    return rows.select("c_custkey", (F.col("tx") + F.col("dx")).alias("x"), "ty", F.explode(step).alias("dy")).select("c_custkey", "x", (F.col("ty") + F.col("dy")).alias("y"))


@query(f"""WITH {_RING_SQL}, p AS (SELECT n_nationkey, 137.0::DOUBLE + (n_nationkey * 331 % 1000) / 1000.0::DOUBLE AS lon, 36.0::DOUBLE + (n_nationkey * 577 % 1000) / 1000.0::DOUBLE AS lat FROM nation),
inside AS (SELECT n_nationkey, ring FROM p JOIN ed ON y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 WHERE n_nationkey <> ring GROUP BY 1, 2 HAVING count(*) % 2 = 1),
area AS (SELECT ring, max(x) - min(x) AS a FROM pt GROUP BY 1)
SELECT n_nationkey, ring, (row_number() OVER (PARTITION BY n_nationkey ORDER BY a, ring))::INTEGER AS place FROM inside JOIN area USING (ring)""")
def q_containing_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other catchments that hold a dam, the smallest first."""
    k = F.col("n_nationkey")
    points = table(spark, sf_dir, "nation").select("n_nationkey", (F.lit(137.0) + (k * 331 % 1000) / 1000.0).alias("lon"), (F.lit(36.0) + (k * 577 % 1000) / 1000.0).alias("lat"))
    vertices = _rings(spark, sf_dir)
    areas = vertices.groupBy("ring").agg((F.max("x") - F.min("x")).alias("area"))
    return spatial.containing_others(points, spatial.ring_edges(vertices, "ring", ["o", "v"], "x", "y"), areas, "n_nationkey", "ring", "lon", "lat")


@query(f"""WITH {_CUST_SQL}, m AS (SELECT c_custkey, lat, lon, (lon + 180) / 360 * 8192 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192 AS fy FROM c)
SELECT c_custkey, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, floor((fx - floor(fx)) * 256)::BIGINT AS col, floor((fy - floor(fy)) * 256)::BIGINT AS row,
  round(sqrt(pow((36.5 - lat) * 111320, 2) + pow((137.5 - lon) * 111320 * cos(radians((36.5 + lat) / 2)), 2)), 3) AS metres,
  600 + least(CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 13 % 700)::DOUBLE ELSE 0 END, 300) AS allowed,
  floor((lon + 180) / 360 * 512 * 256)::BIGINT AS px FROM m""")
def q_cells_and_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile and cell of a place, its distance from a fixed one, the allowance of a check-in, and its Mercator pixel."""
    lat, lon, k = F.col("lat"), F.col("lon"), F.col("c_custkey")
    x, y = geo.tile_x(lon, 13), geo.tile_y(lat, 13)
    inside = lambda v: F.floor((v - F.floor(v)) * 256)
    return _points(spark, sf_dir, "customer", "c_custkey").select(
        "c_custkey", F.floor(x).alias("x"), F.floor(y).alias("y"), inside(x).alias("col"), inside(y).alias("row"),
        F.round(geo.local_m(lat, lon, F.lit(36.5), F.lit(137.5)), 3).alias("metres"), geo.allowance_m(F.when(k % 4 != 0, (k * 13 % 700).cast("double"))).alias("allowed"),
        F.floor(geo.mercator_x(lon, 8)).alias("px"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_linenumber AS pos, l_partkey FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, min(struct_pack(a := l_partkey, b := x, c := y)) AS m FROM p GROUP BY 1, 2),
w AS (SELECT l_orderkey, l_linenumber, m.b AS x, m.c AS y, lead(m.b) OVER o AS nx, lead(m.c) OVER o AS ny FROM u WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
s AS (SELECT *, coalesce(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0,
  sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS step FROM w),
e AS (SELECT *, (l_orderkey % 40)::DOUBLE AS d FROM s)
SELECT l_orderkey, round(arg_max(CASE WHEN nx IS NULL OR step = 0 THEN x ELSE x + (nx - x) * least((d - t0) / step, 1) END, l_linenumber), 6) AS x,
  round(arg_max(CASE WHEN nx IS NULL OR step = 0 THEN y ELSE y + (ny - y) * least((d - t0) / step, 1) END, l_linenumber), 6) AS y FROM e WHERE t0 <= d GROUP BY 1""")
def q_position_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a traveller stands after a distance along a path, straight between its points and held at the end."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    points = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "x", "y")).alias("m")).select("l_orderkey", "l_linenumber", "m.x", "m.y")
    at = spatial.position_at(points, "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 40).cast("double"))
    return at.select("l_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {_RING_SQL}, v AS (SELECT ring, i, x1, y1, coalesce(lag(x1) OVER w, last_value(x1) OVER z) AS px, coalesce(lag(y1) OVER w, last_value(y1) OVER z) AS py, x2, y2 FROM ed
  WINDOW w AS (PARTITION BY ring ORDER BY i), z AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, sqrt(pow(px - x1, 2) + pow(py - y1, 2)) * sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM v)
SELECT ring, i, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(len, 0) >= 0.87, false) AS spike FROM c""")
def q_ring_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of closed rings whose corner is a spike."""
    return spatial.spikes(spatial.ring_edges(_rings(spark, sf_dir), "ring", ["o", "v"], "x", "y"), "ring").select("ring", "i", "spike")
