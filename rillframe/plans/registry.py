"""Registry, rule and merge queries over the star-schema tables.

Analogues: region = prefecture, nation = registry row, supplier = station,
customer = dam, orders = product state, events = observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.functions import text
from rillframe.operators import measure, relate, rules, season, select
from rillframe.plans.coverage import MEASURED_SQL, measured
from rillframe.plans.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None):
    """Register the function under its name, with its DuckDB text."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# --- measurements -----------------------------------------------------------


@query(f"""WITH {MEASURED_SQL}, s AS (SELECT user_id, coalesce(max(status) FILTER (event_type = 'purchase'), 'no_source') AS a,
  coalesce(max(status) FILTER (event_type = 'view'), 'no_source') AS b FROM measured GROUP BY 1)
SELECT user_id, a, b, CASE WHEN a = 'ok' AND b = 'ok' THEN 'ok' WHEN a = 'ok' OR b = 'ok' THEN 'partial' ELSE a END AS status FROM s""")
def q_status_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status from two rates: both, one, or the first one's own."""
    rows = measured(spark, sf_dir).groupBy("user_id").agg(
        *[F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("m.status"))), F.lit("no_source")).alias(name) for name, kind in (("a", "purchase"), ("b", "view"))])
    return rows.select("user_id", "a", "b", measure.record_status(F.col("a"), F.col("b")).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity >= 40 THEN 4 WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 10 THEN 2
  WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS bin FROM lineitem""")
def q_threshold_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-open bin of a value."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", measure.bin_index(F.col("l_quantity"), [5, 10, 25, 40]).alias("bin"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS md,
  strftime(o_orderdate, '%m-%d') BETWEEN '06-15' AND '09-30' AS summer, strftime(o_orderdate, '%m-%d') >= '11-01' OR strftime(o_orderdate, '%m-%d') <= '03-15' AS winter FROM orders""")
def q_season_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of a season, also of one that runs over the new year."""
    md = season.month_day(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", md.alias("md"), season.in_season(md, F.lit("06-15"), F.lit("09-30")).alias("summer"), season.in_season(md, F.lit("11-01"), F.lit("03-15")).alias("winter"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, c_acctbal * 60 AS eff, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * (c_custkey % 4) * 5 END AS flood,
    c_acctbal * (c_custkey % 2) * 5 AS nonflood, CASE WHEN o_custkey % 11 <> 0 THEN strftime(o_orderdate, '%m-%d') BETWEEN '06-15' AND '09-30' END AS s
  FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT *, CASE WHEN flood IS NOT NULL AND nonflood IS NOT NULL THEN eff - CASE WHEN flood = nonflood THEN flood WHEN s THEN flood WHEN NOT s THEN nonflood END END AS den FROM o)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderstatus = 'O' AND den > 0 THEN o_totalprice / den * 100 END END AS rate FROM d""")
def q_reference_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculated rate from capacities, adopted only where no official one is ok."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = F.col("c_custkey")
    s = F.when(F.col("o_custkey") % 11 != 0, season.in_season(season.month_day(F.col("o_orderdate")), F.lit("06-15"), F.lit("09-30")))
    rate = season.reference_rate(F.col("o_totalprice"), F.col("o_orderstatus") == "O", F.col("c_acctbal") * 60,
                                 F.when(c % 5 != 0, F.col("c_acctbal") * (c % 4) * 5), F.col("c_acctbal") * (c % 2) * 5, s)
    official = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("missing")
    return rows.select("o_orderkey", season.adopt(official, rate).alias("rate"))


# --- joins ------------------------------------------------------------------


@query("""SELECT s_suppkey, lpad((s_suppkey % 100000)::VARCHAR, 5, '0') || lpad((s_nationkey % 1000)::VARCHAR, 3, '0') || lpad((s_suppkey * 7 % 100000)::VARCHAR, 5, '0') AS code FROM supplier""")
def q_station_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.station_code(k % 100000, F.col("s_nationkey") % 1000, k * 7 % 100000).alias("code"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END), ''), nullif(trim(n_name), ''), 'none') AS label
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_overlay_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry beats master; blank text counts as absent."""
    own = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce(text.present(own), text.present(F.col("n_name")), F.lit("none")).alias("label"))


_ASOF_SQL = """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(v.ts) <= 21600000000 THEN view_id END AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


@query(_ASOF_SQL)
def q_asof_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest view at or before a purchase and within six hours."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("view_id"))
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relate.asof(buys, views, "user_id", "ts", "vts", ["view_id"], 6 * 3600).select("event_id", "view_id")


@query("""SELECT c_custkey, coalesce(n_name, 'unknown-' || c_nationkey) AS nation, coalesce(r_name, 'unknown') AS region FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 6 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_left_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained left joins to dimensions with fallback names."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    rows = relate.with_dimension(table(spark, sf_dir, "customer"), nation, ["c_nationkey"], nation=F.concat(F.lit("unknown-"), F.col("c_nationkey")))
    return relate.with_dimension(rows, region, ["n_regionkey"], region="unknown").select("c_custkey", "nation", "region")


@query("""SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def q_inner_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_acctbal")


@query("""SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def q_anti_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relate.unknown_keys(table(spark, sf_dir, "customer"), known, ["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""")
def q_semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(known, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT p_partkey AS k, p_size % 3 AS va FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT l_partkey AS k, min(l_linenumber) AS vb FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
SELECT k, va, vb, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN va IS NOT DISTINCT FROM vb THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (k)""")
def q_full_outer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("va"))
    b = table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_linenumber").alias("vb"))
    return relate.audit(a, b, "k", "va", "vb")


# --- aggregates -------------------------------------------------------------


@query("""WITH seg AS (SELECT DISTINCT c_mktsegment FROM customer), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2)
SELECT n_name, seg.c_mktsegment, coalesce(n, 0) AS n FROM nation CROSS JOIN seg LEFT JOIN c ON c_nationkey = n_nationkey AND c.c_mktsegment = seg.c_mktsegment""")
def q_status_counts_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every pair of the registries, zeros included."""
    customer = table(spark, sf_dir, "customer")
    every = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(customer.select("c_mktsegment").distinct())  # two small registries
    n = customer.where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return every.join(n, ["n_nationkey", "c_mktsegment"], "left").select("n_name", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT r_name, c_mktsegment, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS holds FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def q_class_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class totals by region, class, both and overall."""
    rows = (table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("holds"))


_RELEASE_SQL = """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 17 = 0 THEN 'held' WHEN o_orderstatus <> 'F' THEN 'not_exact' WHEN o_orderkey % 5 = 0 THEN 'unapproved'
  WHEN o_orderkey % 7 <> o_custkey % 7 THEN 'stale' ELSE 'approved' END AS status FROM orders"""


@query(f"""WITH r AS ({_RELEASE_SQL}) SELECT o_orderpriority, status, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM r GROUP BY 1, 2""")
def q_release_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by release state, in registry order."""
    k = F.col("o_orderkey")
    method = F.when(F.col("o_orderstatus") == "F", "exact")
    status = rules.release_status(k % 17 == 0, method, F.when(k % 5 != 0, k % 7), F.col("o_custkey") % 7)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", status.alias("status"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"), ids.alias("ids"))


# --- rules ------------------------------------------------------------------


def _supplier_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per supplier, its figures taken from the key."""
    k = F.col("s_suppkey")
    part = lambda a, m: ((k * a) % m).cast("double")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey",
        F.when(k % 3 != 0, part(7, 41) - 20).alias("area_error_pct"), F.when(k % 4 != 0, part(11, 37) - 18).alias("grid_drift_pct"), (part(13, 30) / 2).alias("unreached_pct"),
        (part(17, 12) / 4).alias("mask_far_outside_pct"), (part(19, 16) / 2).alias("ring_far_only_pct"), (part(23, 11) / 4).alias("path_outside_pct"),
        F.when(k % 29 == 0, 1.0).otherwise(0.0).alias("ring_self_intersections"), (part(31, 8) + 92).alias("mask_largest_pct"),
        (k % 23 == 0).alias("touches_edge"), F.when(k % 19 == 0, k % 5).otherwise(0).alias("nodata_adjacent"), F.when(k % 31 == 0, 1).otherwise(0).alias("legacy_empty_tiles"),
        F.when(k % 37 == 0, 1).otherwise(0).alias("missing_tiles"), F.when(k % 3 != 0, part(1, 90) + 1).alias("official_area"), F.when(k % 5 != 0, part(3, 80) + 1).alias("reference_area"),
        F.when(k % 7 != 0, part(5, 33) - 16).alias("reference_error"),
        F.when(k % 4 == 0, "yes").when(k % 4 == 1, "none").otherwise("unknown").alias("diversion"), F.when(k % 2 == 0, "snap").otherwise("reservoir").alias("outlet_method"),
        F.when(k % 41 == 0, "cause unknown").alias("hold"), F.when(k % 6 == 0, part(2, 5) / 2 - 1).alias("fine_recompute_pct"), (k % 43 == 0).alias("failed"))


_FIGURES_SQL = """f AS (SELECT s_suppkey, s_nationkey, CASE WHEN k % 3 <> 0 THEN k * 7 % 41 - 20 END::DOUBLE AS area_error_pct, CASE WHEN k % 4 <> 0 THEN k * 11 % 37 - 18 END::DOUBLE AS grid_drift_pct,
  (k * 13 % 30)::DOUBLE / 2 AS unreached_pct, (k * 17 % 12)::DOUBLE / 4 AS mask_far_outside_pct, (k * 19 % 16)::DOUBLE / 2 AS ring_far_only_pct, (k * 23 % 11)::DOUBLE / 4 AS path_outside_pct,
  CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS crossings, (k * 31 % 8 + 92)::DOUBLE AS mask_largest_pct, k % 23 = 0 AS touches_edge, CASE WHEN k % 19 = 0 THEN k % 5 ELSE 0 END AS nodata_adjacent,
  k % 31 = 0 AS legacy, k % 37 = 0 AS missing, CASE WHEN k % 3 <> 0 THEN k % 90 + 1 END::DOUBLE AS official_area, CASE WHEN k % 5 <> 0 THEN k * 3 % 80 + 1 END::DOUBLE AS reference_area,
  CASE WHEN k % 7 <> 0 THEN k * 5 % 33 - 16 END::DOUBLE AS reference_error, CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'none' ELSE 'unknown' END AS diversion,
  k % 2 = 0 AS snap, k % 41 = 0 AS hold, CASE WHEN k % 6 = 0 THEN (k * 2 % 5)::DOUBLE / 2 - 1 END AS fine, k % 43 = 0 AS failed FROM (SELECT *, s_suppkey AS k FROM supplier)),
g AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN hold THEN 'manual_hold' END, CASE WHEN abs(area_error_pct) > 15 THEN 'area_error' END, CASE WHEN abs(grid_drift_pct) > 15 THEN 'grid_drift' END,
  CASE WHEN unreached_pct > 10 THEN 'unreached' END, CASE WHEN mask_far_outside_pct > 2 THEN 'rain_outside_ring' END, CASE WHEN ring_far_only_pct > 5 THEN 'ring_without_rain' END,
  CASE WHEN path_outside_pct > 2 THEN 'path_leaves_ring' END, CASE WHEN crossings > 0 THEN 'ring_self_intersects' END, CASE WHEN mask_largest_pct < 95 THEN 'mask_fragmented' END,
  CASE WHEN touches_edge THEN 'dem_edge' END, CASE WHEN nodata_adjacent > 0 THEN 'dem_nodata_adjacent' END, CASE WHEN legacy THEN 'dem_unverified_empty_tile' END,
  CASE WHEN missing THEN 'dem_missing_tile' END, CASE WHEN abs(fine) > 1 THEN 'fine_recompute_mismatch' END] IF x IS NOT NULL], ',') AS blocks,
  array_to_string([x FOR x IN [CASE WHEN official_area IS NULL THEN 'no_official_direct_area' END, CASE WHEN diversion = 'unknown' THEN 'diversion_unknown' END,
  CASE WHEN diversion = 'yes' THEN 'diversion_yes' END, CASE WHEN snap THEN 'no_reservoir_surface' END] IF x IS NOT NULL], ',') AS warns FROM f),
h AS (SELECT *, CASE WHEN failed THEN 'UNEVALUABLE' WHEN regexp_matches(blocks, 'fine_recompute|dem_') THEN 'FAIL' WHEN blocks <> '' THEN 'HOLD' WHEN warns <> '' THEN 'WARN' ELSE 'PASS' END AS cls,
  CASE WHEN official_area IS NOT NULL THEN 'official' WHEN reference_area IS NULL THEN 'no_material' WHEN abs(reference_error) <= 15 THEN 'ref_ok' ELSE 'ref_divergent' END AS material FROM g)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _supplier_figures(spark, sf_dir)
    figures = {c: F.col(c) for c in rows.columns}
    rows = rows.withColumn("gate", rules.gate(figures))
    rows = rows.withColumn("cls", rules.qa_class(F.col("failed"), F.col("gate.block_codes"), F.col("gate.warn_codes")))
    return rows.withColumn("material", rules.material(F.col("official_area"), F.col("reference_area"), F.col("reference_error")))


@query(f"""WITH {_FIGURES_SQL} SELECT s_suppkey, CASE WHEN blocks = '' THEN 'pass' ELSE 'hold' END AS status, blocks, warns, cls, material,
  cls IN ('HOLD', 'FAIL', 'UNEVALUABLE') OR (cls = 'WARN' AND material IN ('ref_divergent', 'no_material')) AS human FROM h""")
def q_qa_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, class, verification material and review flag of every product."""
    return _gated(spark, sf_dir).select(
        "s_suppkey", F.col("gate.status").alias("status"), F.array_join("gate.block_codes", ",").alias("blocks"), F.array_join("gate.warn_codes", ",").alias("warns"),
        "cls", "material", rules.needs_human(F.col("cls"), F.col("material")).alias("human"))


@query(f"""WITH {_FIGURES_SQL} SELECT s_nationkey, CASE WHEN cls NOT IN ('PASS', 'WARN') THEN 'G4' WHEN official_area IS NOT NULL AND diversion = 'yes' THEN 'G2' WHEN official_area IS NOT NULL THEN 'G1'
  WHEN reference_area IS NOT NULL AND abs(reference_error) <= 15 THEN 'G3' ELSE 'G4' END AS grp, count(*) AS n FROM h GROUP BY 1, 2""")
def q_evidence_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("reference_area").isNotNull(), F.col("reference_error"))
    grp = rules.evidence_group(F.col("cls"), F.col("official_area"), F.col("diversion"), error)
    return _gated(spark, sf_dir).groupBy("s_nationkey", grp.alias("grp")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 51 = 0 THEN 'dup' ELSE c_name END AS id, c_nationkey, c_acctbal, c_mktsegment, c_custkey FROM customer)
SELECT c_custkey, 'blank_id' AS rule FROM r WHERE id = '' UNION ALL SELECT c_custkey, 'duplicate_id' FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r WHERE id <> '') WHERE n > 1
UNION ALL SELECT c_custkey, 'unknown_key' FROM r WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3) UNION ALL SELECT c_custkey, 'negative' FROM r WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'no_source' FROM r WHERE c_mktsegment = 'BUILDING' AND c_custkey % 9 = 0""")
def q_registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraint violations as one table; an empty result means a valid registry."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("id", F.when(k % 50 == 0, "").when(k % 51 == 0, "dup").otherwise(F.col("c_name")))
    known = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"))
    often = rows.where("id <> ''").groupBy("id").count().where("count > 1").select("id")
    parts = [
        (rows.where("id = ''"), "blank_id"), (rows.join(often, "id", "left_semi"), "duplicate_id"), (relate.unknown_keys(rows, known, ["c_nationkey"]), "unknown_key"),
        (rows.where("c_acctbal < 0"), "negative"), (rows.where((F.col("c_mktsegment") == "BUILDING") & (k % 9 == 0)), "no_source"),
    ]
    out = None
    for df, rule in parts:
        one = df.select("c_custkey", F.lit(rule).alias("rule"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT n_nationkey, n_name, n_regionkey AS ord FROM nation WHERE split_part(n_name, '_', 1) IN ('A') OR n_nationkey IN (3, 7, 11) OR contains(lower(n_name), '2')""")
def q_target_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by prefix, exact key or part of the name; nothing asked for selects nothing."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.regexp_replace("n_name", "_.*", ""), F.lit("-"), F.col("n_nationkey")).alias("dam_id"),
                                                 F.lower("n_name").alias("name"), F.col("n_regionkey").alias("ord"))
    return select.select_targets(rows, prefixes=["A"], ids=["NATION-3", "NATION-7", "NATION-11"], name_part="2").select("n_nationkey", "n_name", "ord")


@query("""WITH p AS (SELECT p_partkey, p_size * 4.0::DOUBLE AS area FROM part), z AS (SELECT *, CASE WHEN area < 30 THEN 14 WHEN area < 150 THEN 13 ELSE 12 END AS zoom FROM p)
SELECT p_partkey, zoom, greatest(1, ceil((2.6::DOUBLE * sqrt(area) + 3) / (2 * pi() * 6378137 * cos(radians(36.6::DOUBLE)) / 1000 / pow(2, zoom)) / 2))::INTEGER AS pad FROM z""")
def q_zoom_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("p_size") * 4.0
    return table(spark, sf_dir, "part").select("p_partkey", rules.zoom(area).alias("zoom"), rules.pad(area).alias("pad"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS ok, max(ts) AS latest FROM events GROUP BY 1),
l AS (SELECT *, lag(total) OVER (ORDER BY day) AS old_total, lag(ok) OVER (ORDER BY day) AS old_ok, lag(latest) OVER (ORDER BY day) AS old_latest FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, total, failed > 0 AND failed * 3 >= total AS failing, coalesce(old_total <> total, false) AS changed, coalesce(old_ok >= 4 AND ok * 2 < old_ok, false) AS halved,
  coalesce(latest < old_latest, false) AS backwards FROM l""")
def q_run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's batch against the one before: failures, changed size, halved successes, time running backwards."""
    day = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.max("ts").alias("latest"))
    w = Window.orderBy("d")  # one row a run
    old = lambda c: F.lag(c).over(w)
    rows = day.select("*", old("total").alias("old_total"), old("ok").alias("old_ok"), old("latest").alias("old_latest"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        F.date_format("d", "yyyy-MM-dd").alias("day"), "total", ((F.col("failed") > 0) & (F.col("failed") * 3 >= F.col("total"))).alias("failing"),
        yes(F.col("old_total") != F.col("total")).alias("changed"), yes((F.col("old_ok") >= 4) & (F.col("ok") * 2 < F.col("old_ok"))).alias("halved"),
        yes(F.col("latest") < F.col("old_latest")).alias("backwards"))


# --- merges and sets --------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 13 <> 0 THEN ts END AS seen_at, value, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) AS k FROM events)
SELECT user_id, event_type, epoch_us(seen_at)::BIGINT AS at_us, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seen_at ASC NULLS LAST, side) AS rn FROM e WHERE k = 1) WHERE rn = 1""")
def q_visit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two visit logs by key: the earliest record wins as a whole, ties keep the current one."""
    w = Window.partitionBy("user_id", "event_type", "side").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("side", F.col("event_id") % 2).withColumn("k", F.row_number().over(w)).where("k = 1").select(
        "user_id", "event_type", F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("at"), "value", "side")
    merged = relate.earliest_wins(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"), ["user_id", "event_type"], "at")
    return merged.select("user_id", "event_type", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "value")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'N' AS o_orderstatus, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice * 2 END AS o_totalprice FROM orders WHERE o_orderkey % 4 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus,
  CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def q_keyed_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by key: new rows win as a whole, nulls included; keys that failed keep the old row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") * 2).alias("o_totalprice"))
    return relate.overwrite(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT k, 'both' AS part FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'left' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def q_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    named = lambda df, part: df.select("k", F.lit(part).alias("part"))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "left")).unionByName(named(b.subtract(a), "right"))


# --- labels -----------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN age IS NULL THEN 'unknown' WHEN age >= 14 THEN 'warn' WHEN age >= 7 THEN 'notice' ELSE 'fresh' END AS level, greatest(0, floor(age))::BIGINT AS days
FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE END AS age FROM events)""")
def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age levels against a fixed present."""
    micros = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    age = F.when(F.col("event_id") % 9 != 0, micros / 86400000000.0)
    return table(spark, sf_dir, "events").select("event_id", rules.freshness(age).alias("level"), F.when(age.isNotNull(), F.greatest(F.lit(0), F.floor(age))).otherwise(F.lit(0)).cast("bigint").alias("days"))


@query("""SELECT p_partkey, p_name, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution, n FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)""")
def q_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name leads to one row, or to a list of candidates."""
    n = F.count("*").over(Window.partitionBy("p_brand", "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(n == 1, "unique").otherwise("ambiguous").alias("resolution"), n.alias("n"))


@query("""SELECT n_nationkey, substr(sha256(n_nationkey || '|' || n_name || '|' || n_regionkey), 1, 12) AS version FROM nation""")
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is the first twelve digits of the content's SHA-256."""
    return table(spark, sf_dir, "nation").select("n_nationkey", text.content_version("n_nationkey", "n_name", "n_regionkey").alias("version"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages""")
def q_host_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query("""SELECT doc_id, regexp_replace(source || CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG.webp' WHEN 2 THEN '.txt' ELSE '' END, '(?i)(\\.(png|jpg|jpeg|webp))+$', '') AS stem FROM documents""")
def q_strip_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.concat("source", F.when(k == 0, ".png").when(k == 1, ".JPG.webp").when(k == 2, ".txt").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.image_stem(name).alias("stem"))


@query("""SELECT p_partkey, CASE WHEN v < 10 THEN format('{:.1f}', v) ELSE format('{:,}', v::BIGINT) END AS area, CASE WHEN p_size * 60 < 50 THEN 'here' WHEN p_size * 60 >= 1000 THEN format('{:.1f}', p_size * 60 / 1000.0::DOUBLE) || ' km' ELSE (p_size * 60) || ' m' END AS distance
FROM (SELECT p_partkey, p_size, (p_size * p_size) / 2.0::DOUBLE - (CASE WHEN p_size % 2 = 1 AND p_size * p_size >= 20 THEN 0.5 ELSE 0 END) AS v FROM part)""")
def q_format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and distances as shown; values are exact in binary, so all roundings agree."""
    size = F.col("p_size")
    v = size * size / 2.0 - F.when((size % 2 == 1) & (size * size >= 20), 0.5).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", text.area_label(v).alias("area"), text.distance_label(size * 60).alias("distance"))
