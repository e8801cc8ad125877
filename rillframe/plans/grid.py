"""Raster queries on a small grid that is summed from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.operators import grid
from rillframe.plans.tables import table
from rillframe.storage import lineage_cut

QUERIES: dict = {}
ORACLES: dict = {}
N = 24


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, z): elevations are sums of whole quantities."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j"), F.col("l_quantity").cast("bigint").alias("q"))
    return rows.groupBy("i", "j").agg(F.sum("q").alias("z"))


GRID_SQL = f"""g AS MATERIALIZED (SELECT (l_orderkey % {N})::INTEGER AS i, (l_partkey % {N})::INTEGER AS j, sum(l_quantity::BIGINT)::BIGINT AS z FROM lineitem GROUP BY 1, 2),
st(k, di, dj, far) AS (VALUES (0, -1, 0, 1.0::DOUBLE), (1, -1, 1, 1.4142), (2, 0, 1, 1.0), (3, 1, 1, 1.4142), (4, 1, 0, 1.0), (5, 1, -1, 1.4142), (6, 0, -1, 1.0), (7, -1, -1, 1.4142)),
nb AS (SELECT a.i, a.j, a.z, k, far, b.i AS ni, b.j AS nj, b.z AS nz FROM g a, st, g b WHERE b.i = a.i + di AND b.j = a.j + dj),
d8 AS MATERIALIZED (SELECT g.i, g.j, coalesce(k, -1)::INTEGER AS d FROM g LEFT JOIN (SELECT i, j, k, row_number() OVER (PARTITION BY i, j ORDER BY (z - nz) / far DESC, k) AS rn FROM nb WHERE nz < z) b ON g.i = b.i AND g.j = b.j AND rn = 1),
nx AS MATERIALIZED (SELECT d8.i, d8.j, d8.i + di AS ni, d8.j + dj AS nj FROM d8 JOIN st ON d = k),
up AS (SELECT i, j, i AS ti, j AS tj FROM g UNION ALL SELECT up.i, up.j, ni, nj FROM up JOIN nx ON nx.i = ti AND nx.j = tj)"""


def _keyed(df: DataFrame, i: str, j: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(i) * N + F.col(j))


@query(f"WITH RECURSIVE {GRID_SQL} SELECT i, j, d FROM d8")
def q_d8_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest descent of every cell."""
    return grid.d8(cells(spark, sf_dir))


@query(f"WITH RECURSIVE {GRID_SQL} SELECT ti AS i, tj AS j, count(*) AS acc FROM up GROUP BY 1, 2")
def q_flow_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that drain through each cell, itself included."""
    return grid.accumulate(grid.pointers(cells(spark, sf_dir)), lineage_cut(spark, "accumulation")).select("node.i", "node.j", "acc")


@query(f"WITH RECURSIVE {GRID_SQL}, top AS (SELECT ti, tj FROM up GROUP BY 1, 2 ORDER BY count(*) DESC, ti, tj LIMIT 3) SELECT DISTINCT up.i, up.j FROM up JOIN top USING (ti, tj)")
def q_upstream_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells above the three largest outlets."""
    cut = lineage_cut(spark, "upstream")
    ways = cut(grid.pointers(cells(spark, sf_dir)))
    top = grid.accumulate(ways, cut).orderBy(F.desc("acc"), "node").limit(3)
    return grid.upstream(ways, top, cut).select("node.i", "node.j")


_MASK_SQL = "mk AS (SELECT i, j, z % 5 < 2 AS m FROM g)"


@query(f"""WITH RECURSIVE {GRID_SQL}, {_MASK_SQL}, o AS (SELECT i, j, i * 2147483648 + j AS k FROM mk WHERE m),
cl(k, r) AS (SELECT k, k FROM o UNION SELECT cl.k, b.k FROM cl JOIN o a ON a.k = cl.r JOIN o b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1)
SELECT i, j, min(r) AS label FROM cl JOIN o USING (k) GROUP BY 1, 2""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-connected pieces of a mask."""
    cut = lineage_cut(spark, "components")
    return grid.components(cut(cells(spark, sf_dir).where("z % 5 < 2").select("i", "j")), cut)


@query(f"WITH RECURSIVE {GRID_SQL} SELECT a.i, a.j, max(b.z) - min(b.z) AS spread FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2 HAVING count(*) = 9")
def q_local_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.local_range(cells(spark, sf_dir))


@query(f"WITH RECURSIVE {GRID_SQL} SELECT i // 5 AS bi, j // 5 AS bj, avg(CASE WHEN z % 7 <> 0 THEN z END) AS mean FROM g WHERE i < 20 AND j < 20 GROUP BY 1, 2")
def q_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 5 x 5 blocks; missing cells count for nothing."""
    rows = cells(spark, sf_dir).select("i", "j", F.when(F.col("z") % 7 != 0, F.col("z").cast("double")).otherwise(F.lit(float("nan"))).alias("z"))
    return grid.block_mean(rows, 5, N, N)


@query(f"WITH RECURSIVE {GRID_SQL}, {_MASK_SQL} SELECT i // 4 AS bi, j // 4 AS bj, sum(m::INTEGER) * 2 >= 16 AS most, bool_or(m) AS any_in FROM mk GROUP BY 1, 2")
def q_block_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.block_majority(cells(spark, sf_dir).select("i", "j", (F.col("z") % 5 < 2).alias("m")), 4)


@query(f"WITH RECURSIVE {GRID_SQL} SELECT DISTINCT i + a AS i, j + b AS j FROM g, (SELECT unnest([-2, -1, 0, 1, 2]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS b) WHERE z % 37 = 0 AND i + a BETWEEN 0 AND {N - 1} AND j + b BETWEEN 0 AND {N - 1}")
def q_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dilate(cells(spark, sf_dir).where("z % 37 = 0"), 2, N, N)


@query(f"""WITH RECURSIVE {GRID_SQL}, t AS (SELECT z % 5 < 2 AS a, z % 3 = 0 AS b FROM g) SELECT sum((a AND b)::INTEGER)::BIGINT AS both_in, sum((a OR b)::INTEGER)::BIGINT AS any_in,
sum((a AND b)::INTEGER)::DOUBLE / greatest(1, sum((a OR b)::INTEGER)) AS iou, sum((a AND NOT b)::INTEGER)::DOUBLE / greatest(1, sum(a::INTEGER)) AS outside FROM t""")
def q_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two masks."""
    rows = cells(spark, sf_dir).select((F.col("z") % 5 < 2).alias("a"), (F.col("z") % 3 == 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    share = lambda x, of: F.count_if(x).cast("double") / F.greatest(F.lit(1), F.count_if(of))
    return rows.agg(F.count_if(a & b).alias("both_in"), F.count_if(a | b).alias("any_in"), share(a & b, a | b).alias("iou"), share(a & ~b, a).alias("outside"))


@query(f"""WITH RECURSIVE {GRID_SQL}, w AS (SELECT up.i, up.j, ti, tj, a.z % 3 = 1 AS bad, a.z < 0.6 * avg(a.z) OVER () AS goal FROM up JOIN g a ON a.i = ti AND a.j = tj)
SELECT i, j, bool_or(NOT EXISTS (SELECT 1 FROM nx WHERE nx.i = ti AND nx.j = tj) AND (ti + tj) % 2 = 0) AS reached, bool_or(bad) AS leaves FROM w GROUP BY 1, 2""")
def q_reach_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cell's way ends at a goal, and whether it passes a forbidden cell; by pointer doubling."""
    cut = lineage_cut(spark, "reach")
    base = cells(spark, sf_dir)
    node = F.col("i") * N + F.col("j")
    steps = _keyed(grid.next_cell(grid.d8(base)), "ni", "nj", "next").select(node.alias("node"), "next")
    own = base.select(node.alias("node"), (F.col("z") % 3 == 1).alias("carry"))
    start = cut(own.join(steps, "node", "left").select("node", F.coalesce("next", "node").alias("next"), "carry"))
    ends = grid.doubled(start, 10, cut)  # 1,024 steps pass every cell of the grid
    i, j = F.expr(f"cast(node div {N} as int)"), F.expr(f"cast(node % {N} as int)")
    return ends.select(i.alias("i"), j.alias("j"), (F.expr(f"(next div {N} + next % {N}) % 2") == 0).alias("reached"), F.col("carry").alias("leaves"))


@query(f"""WITH RECURSIVE {GRID_SQL}, tr AS (SELECT i AS pi, j AS pj, i, j, 0 AS pos FROM g WHERE (i + j) % 11 = 0 UNION ALL SELECT pi, pj, ni, nj, pos + 1 FROM tr JOIN nx USING (i, j)),
sg AS (SELECT pi, pj, pos, i, j, CASE WHEN lead(i) OVER w IS NULL THEN 0 WHEN lead(i) OVER w <> i AND lead(j) OVER w <> j THEN 14142 ELSE 10000 END AS step FROM tr WINDOW w AS (PARTITION BY pi, pj ORDER BY pos))
SELECT pi, pj, pos, i, j, (sum(step) OVER (PARTITION BY pi, pj ORDER BY pos) - step)::BIGINT AS travelled FROM sg""")
def q_path_cumdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance along each traced way, in ten-thousandths of a cell."""
    base = cells(spark, sf_dir)
    cut = lineage_cut(spark, "paths")
    nxt = cut(grid.next_cell(grid.d8(base)))
    at = base.where((F.col("i") + F.col("j")) % 11 == 0).select(F.col("i").alias("pi"), F.col("j").alias("pj"), "i", "j", F.lit(0).alias("pos"))
    every = now = cut(at)
    while now.limit(1).count():
        now = cut(now.join(nxt, ["i", "j"]).select("pi", "pj", F.col("ni").alias("i"), F.col("nj").alias("j"), (F.col("pos") + 1).alias("pos")))
        every = every.unionByName(now)
    w = Window.partitionBy("pi", "pj").orderBy("pos")
    di, dj = F.lead("i").over(w) != F.col("i"), F.lead("j").over(w) != F.col("j")
    steps = every.withColumn("step", F.when(F.lead("i").over(w).isNull(), 0).when(di & dj, 14142).otherwise(10000)).withColumn("path", F.col("pi") * N + F.col("pj"))
    return grid.path_positions(steps, "path", "pos", "step").select("pi", "pj", "pos", "i", "j", "travelled")


def q_fill_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depressions filled to the lowest way out; an iteration, checked against the kernel in the tests."""
    return grid.minimax_fill(cells(spark, sf_dir), lineage_cut(spark, "fill"))


QUERIES["q_fill_minimax"] = q_fill_minimax


@query(f"""WITH RECURSIVE {GRID_SQL}, c AS (SELECT i, j, CASE WHEN d < 0 THEN 15 ELSE d END AS code FROM d8) SELECT i, count(*) AS n, string_agg(substr('0123456789ABCDEF', code + 1, 1), '' ORDER BY j) AS packed FROM c GROUP BY 1""")
def q_pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction codes of a row as four-bit digits, high nibble first, 15 for none."""
    code = F.when(F.col("d") < 0, 15).otherwise(F.col("d"))
    rows = grid.d8(cells(spark, sf_dir)).groupBy("i").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("j", F.hex(code).alias("h")))).alias("c"))
    return rows.select("i", "n", F.array_join("c.h", "").alias("packed"))


@query(f"WITH RECURSIVE {GRID_SQL} SELECT i // 6 AS bi, j // 6 AS bj, median(z)::DOUBLE AS level FROM g GROUP BY 1, 2")
def q_median_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median of each block: the mean of the two middle values where their number is even."""
    return cells(spark, sf_dir).groupBy(F.expr("i div 6").alias("bi"), F.expr("j div 6").alias("bj")).agg(F.median("z").alias("level"))


_TWO_SQL = f"""g AS MATERIALIZED (SELECT l_returnflag AS f, (l_orderkey % {N})::INTEGER AS i, (l_partkey % {N})::INTEGER AS j, sum(l_quantity::BIGINT)::BIGINT AS z FROM lineitem GROUP BY 1, 2, 3),
st(k, di, dj, far) AS (VALUES (0, -1, 0, 1.0::DOUBLE), (1, -1, 1, 1.4142), (2, 0, 1, 1.0), (3, 1, 1, 1.4142), (4, 1, 0, 1.0), (5, 1, -1, 1.4142), (6, 0, -1, 1.0), (7, -1, -1, 1.4142)),
nx AS MATERIALIZED (SELECT f, i, j, ni, nj FROM (SELECT a.f, a.i, a.j, b.i AS ni, b.j AS nj, row_number() OVER (PARTITION BY a.f, a.i, a.j ORDER BY (a.z - b.z) / far DESC, k) AS rn
  FROM g a, st, g b WHERE b.f = a.f AND b.i = a.i + di AND b.j = a.j + dj AND b.z < a.z) WHERE rn = 1),
up AS (SELECT f, i, j, i AS ti, j AS tj FROM g UNION ALL SELECT up.f, up.i, up.j, ni, nj FROM up JOIN nx ON nx.f = up.f AND nx.i = ti AND nx.j = tj)"""


@query(f"WITH RECURSIVE {_TWO_SQL} SELECT f, ti AS i, tj AS j, count(*) AS acc FROM up GROUP BY 1, 2, 3")
def q_flow_accum_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulation on several grids at once, told apart by a key."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), (F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j"))
    base = rows.agg(F.sum(F.col("l_quantity").cast("bigint")).alias("z"))
    return grid.accumulate(grid.pointers(base, ("f",)), lineage_cut(spark, "accumulation")).select("node.f", "node.i", "node.j", "acc")
