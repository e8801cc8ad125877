"""Refresh, publication, reports, visits and packed grids over the star-schema tables.

Analogues: nation = area, customer = dam, supplier = station master, events = slots,
orders = product state, lineitem = tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe import publish, visits
from rillframe.functions import tables, text
from rillframe.operators import grid, ingest, profile, report, rules, select
from rillframe.plans.registry import _FIGURES_SQL, _gated
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


# --- refresh ----------------------------------------------------------------


@query("""WITH dam AS (SELECT c_custkey, 'n' || c_nationkey AS pref, c_name AS name, c_custkey % 90 AS code FROM customer),
slug AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 's' || c_custkey END AS slug FROM customer WHERE c_custkey % 4 <> 0),
m AS (SELECT s_suppkey AS code, s_name AS office, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS lim, CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN '2001/11/01 00:00' ELSE '2003/06/10 00:00' END AS a,
  CASE WHEN s_suppkey % 7 = 0 THEN 'always' ELSE '2002/02/20 00:00' END AS b FROM supplier WHERE s_suppkey % 8 <> 0),
slot AS (SELECT user_id % 90 AS code, ts, max(event_id) AS id FROM events GROUP BY 1, 2),
st AS (SELECT d.*, slug, office, lim, try_strptime(a, '%Y/%m/%d %H:%M') AS a, try_strptime(b, '%Y/%m/%d %H:%M') AS b, TIMESTAMP '2024-01-20 12:00:00' AS asked FROM dam d LEFT JOIN slug USING (name) LEFT JOIN m USING (code) WHERE split_part(pref, 'n', 2)::INT % 5 <> 0),
j AS (SELECT st.*, CASE WHEN TIMESTAMP '2024-01-20 12:00:00' - slot.ts <= INTERVAL 50 MINUTE THEN slot.ts END AS ts, id FROM st ASOF LEFT JOIN slot ON st.code = slot.code AND st.asked >= slot.ts),
v AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'closed' WHEN id % 6 = 1 THEN 'missing' ELSE 'ok' END AS r1, CASE WHEN id % 3 = 0 THEN 'not_provided' ELSE 'ok' END AS r2, (id % 100)::DOUBLE AS x FROM j),
out AS (SELECT name, pref || '-' || coalesce(nullif(trim(slug), ''), code::VARCHAR) AS dam_id, CASE WHEN ts IS NULL THEN 'fetch_failed' ELSE r1 END AS rate_status, CASE WHEN ts IS NOT NULL AND r1 = 'ok' THEN x END AS rate,
  CASE WHEN ts IS NULL THEN 'fetch_failed' WHEN r1 = 'ok' AND r2 = 'ok' THEN 'ok' WHEN r1 = 'ok' OR r2 = 'ok' THEN 'partial' ELSE r1 END AS data_status, CASE WHEN ts IS NOT NULL THEN 'ok' END AS level_status,
  CASE WHEN ts IS NOT NULL AND lim IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN strftime(a, '%m-%d') <= strftime(b, '%m-%d') THEN '01-20' BETWEEN strftime(a, '%m-%d') AND strftime(b, '%m-%d')
    ELSE '01-20' >= strftime(a, '%m-%d') OR '01-20' <= strftime(b, '%m-%d') END END AS in_season FROM v)
SELECT * FROM out UNION ALL SELECT name, 'n' || pref || '-' || coalesce(nullif(trim(slug), ''), name), 'no_source', NULL, 'no_source', 'no_source', NULL
FROM (SELECT 'part ' || p_partkey AS name, p_size AS pref FROM part WHERE p_partkey % 100 = 0) LEFT JOIN slug USING (name)""")
def q_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole refresh: areas with stations, masters, the newest slot within 50 minutes, dams without a source."""
    k, s, e = F.col("c_custkey"), F.col("s_suppkey"), F.col("event_id")
    customer = table(spark, sf_dir, "customer")
    registry = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("pref"), F.col("c_name").alias("name"), (k % 90).alias("code"))
    areas = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("pref"), F.when(F.col("n_nationkey") % 5 != 0, ingest.STATIONS).otherwise("paper").alias("rate_source"))
    slugs = customer.where(k % 4 != 0).select(F.col("c_name").alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), k)).alias("slug"))
    masters = table(spark, sf_dir, "supplier").where(s % 8 != 0).select(
        s.alias("code"), F.col("s_name").alias("office"), F.when(s % 5 != 0, F.col("s_acctbal")).alias("limit_m"),
        F.when(s % 6 == 0, "").when(s % 2 == 0, "2001/11/01 00:00").otherwise("2003/06/10 00:00").alias("season_from"), F.when(s % 7 == 0, "always").otherwise("2002/02/20 00:00").alias("season_to"))
    x = (e % 100).cast("double")
    raw = {"rate_irrigation": (F.when(e % 6 != 1, x), F.when(e % 4 == 0, 140).otherwise(0)), "rate_effective": (x, F.when(e % 3 == 0, 130).otherwise(0))}
    slots = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 90).alias("code"), "ts").agg(F.max("event_id").alias("event_id")).select(
        "code", "ts", *[c.alias(f"{f}_{n}") for f in ingest.FIGURES for n, c in zip(("raw", "code"), raw.get(f, (x, F.lit(0))))])
    without = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("n"), "p_size").alias("pref"), F.concat(F.lit("part "), "p_partkey").alias("name"), F.lit(" nobody measures ").alias("reason"))
    out = ingest.refresh(registry, areas, slugs, masters, slots, without, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return out.select("name", "dam_id", F.col("rate_irrigation.status").alias("rate_status"), F.col("rate_irrigation.value").alias("rate"), "data_status",
                      F.col("level_m.status").alias("level_status"), "in_season")


@query("SELECT DISTINCT c_custkey % 120 AS code FROM customer WHERE c_custkey % 120 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 8 <> 0)")
def q_missing_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station codes whose master isn't cached: what a refresh has to fetch."""
    registry = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 120).alias("code"))
    return ingest.missing_masters(registry, table(spark, sf_dir, "supplier").where("s_suppkey % 8 <> 0").select(F.col("s_suppkey").alias("code")))


@query("""SELECT user_id, event_id, strftime(ts, '%Y%m%d/%H%M') AS slot, max(ts) OVER () = ts AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_latest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user, its slot, and whether it's the newest of all."""
    events = table(spark, sf_dir, "events")
    rows = select.latest(events, "user_id", "ts", "event_id")
    top = select.high_watermark(rows, "ts")
    return rows.join(top, rows["ts"] == top["latest"], "left").select("user_id", "event_id", select.slot_path(F.col("ts")).alias("slot"), F.col("latest").isNotNull().alias("newest"))


# --- publication ------------------------------------------------------------


def _states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("d"), k).alias("dam_id"), (k * 7919 % 104729).alias("ord"), F.concat(F.lit("content of "), k).alias("content"))
    rows = rows.withColumn("version", F.substring(F.sha2("content", 256), 1, 12))
    some = lambda when, c: F.when(when, c)
    return {
        "dams": rows.select("dam_id", "ord"),
        "states": rows.where(k % 3 != 0).select("dam_id", some(k % 5 != 0, F.col("version")).alias("published_version"), some(k % 7 != 0, F.lit("exact")).alias("published_method")),
        "approvals": rows.where(k % 4 != 0).select("dam_id", F.when(k % 11 == 0, "old").otherwise(F.col("version")).alias("version")),
        "holds": rows.where(k % 17 == 0).select("dam_id", F.lit("cause unknown").alias("reason")), "notes": rows.where(k % 19 == 0).select("dam_id", F.lit("see the report").alias("note")),
        "flows": rows.where((k % 3 != 0) & (k % 5 != 0) | (k % 100 == 0)).select("dam_id", "version", "content")}


_STATES_SQL = """k AS (SELECT o_orderkey AS k, 'd' || o_orderkey AS dam_id, o_orderkey * 7919 % 104729 AS ord, substr(sha256('content of ' || o_orderkey), 1, 12) AS version FROM orders),
c AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'held' WHEN k % 7 = 0 THEN 'not_exact' WHEN k % 4 = 0 THEN 'unapproved' WHEN k % 11 = 0 THEN 'stale' ELSE 'approved' END AS release_status FROM k WHERE k % 3 <> 0 AND k % 5 <> 0)"""


@query(f"""WITH {_STATES_SQL} SELECT dam_id, 'candidate' AS part, version, release_status, CASE WHEN k % 19 = 0 THEN 'see the report' END AS note, CASE WHEN k % 17 = 0 THEN 'cause unknown' END AS hold_reason FROM c
UNION ALL SELECT dam_id, 'public', version, NULL, CASE WHEN k % 19 = 0 THEN 'see the report' END, NULL FROM c WHERE release_status = 'approved'
UNION ALL SELECT dam_id, 'orphan', NULL, NULL, NULL, NULL FROM k WHERE k % 100 = 0""")
def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a publication would write: candidates, the public part without a word of holds, orphans set aside."""
    out = publish.assemble(**_states(spark, sf_dir), prune=True)
    part = lambda name, df: df.drop("ord").withColumn("part", F.lit(name))
    rows = part("candidate", out["candidates"])
    for name, key in (("public", "public"), ("orphan", "orphans")):
        rows = rows.unionByName(part(name, out[key]), allowMissingColumns=True)
    return rows.select("dam_id", "part", "version", "release_status", "note", "hold_reason")


@query(f"""WITH {_STATES_SQL}, r AS (SELECT unnest(['approved', 'unapproved', 'stale', 'held', 'not_exact']) AS release_status), n AS (SELECT release_status, count(*) AS n FROM c GROUP BY 1)
SELECT release_status, coalesce(n, 0) AS n, place, dam_id FROM r LEFT JOIN n USING (release_status) LEFT JOIN (SELECT release_status, row_number() OVER (PARTITION BY release_status ORDER BY ord, dam_id) AS place, dam_id FROM c) USING (release_status)""")
def q_release_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every release state in registry order, a row each; every state is there."""
    s = _states(spark, sf_dir)
    return publish.release_lists(publish.release_index(s["states"], s["approvals"], s["holds"]), s["dams"])


@query(f"""WITH {_STATES_SQL}, f AS (SELECT k, dam_id, CASE WHEN k % 13 = 0 THEN 'older' ELSE version END AS version, k % 23 = 0 AS touched FROM k WHERE k % 29 <> 0), s AS (SELECT * FROM k WHERE k % 3 <> 0 AND k % 5 <> 0)
SELECT coalesce(s.dam_id, f.dam_id) AS dam_id, CASE WHEN s.dam_id IS NULL THEN 'orphan' WHEN f.dam_id IS NULL THEN 'absent' WHEN f.version <> s.version THEN 'other_version' ELSE 'changed' END AS fault
FROM s FULL JOIN f ON s.dam_id = f.dam_id WHERE s.dam_id IS NULL OR f.dam_id IS NULL OR f.version <> s.version OR touched""")
def q_flow_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records that don't fit the states."""
    k = F.substring("dam_id", 2, 20).cast("bigint")
    s = _states(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("dam_id"), F.concat(F.lit("content of "), "o_orderkey").alias("content"))
    flows = rows.where(k % 29 != 0).select("dam_id", F.when(k % 13 == 0, "older").otherwise(F.substring(F.sha2("content", 256), 1, 12)).alias("version"),
                                           F.when(k % 23 == 0, "touched").otherwise(F.col("content")).alias("content"))
    return publish.flow_faults(s["states"], flows)


@query("""SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 4 <> 1 AND o_orderkey % 7 <> 0 AS shown FROM orders""")
def q_public_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's own check of a public index: its tag, and approved, passed and exact."""
    k = F.col("o_orderkey")
    tag, status = F.when(k % 9 != 0, "index/1").otherwise("index/0"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("stale")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rules.released(tag, status, F.when(k % 4 != 1, "pass"), F.when(k % 7 != 0, "exact").otherwise("rough"), "index/1").alias("shown"))


# --- reports ----------------------------------------------------------------


@query(f"""WITH {_FIGURES_SQL} SELECT count(*) FILTER (human) AS review, count(*) AS total, round(count(*) FILTER (human) * 100.0 / count(*), 1) AS pct, count(*) FILTER (blocks = '') AS passed, count(*) FILTER (blocks <> '') AS held
FROM (SELECT *, cls IN ('HOLD', 'FAIL', 'UNEVALUABLE') OR (cls = 'WARN' AND material IN ('ref_divergent', 'no_material')) AS human FROM h)""")
def q_review_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many products a person has to look at, and how many pass."""
    rows = _gated(spark, sf_dir).withColumn("human", rules.needs_human(F.col("cls"), F.col("material")))
    load = report.review_load(rows)
    held = rows.agg(F.count_if(F.col("gate.status") == "pass").alias("passed"), F.count_if(F.col("gate.status") == "hold").alias("held"))
    return load.crossJoin(held)  # one row each


@query(f"""WITH {_FIGURES_SQL}, c AS (SELECT cls, unnest(string_split(CASE WHEN blocks <> '' AND warns <> '' THEN blocks || ',' || warns ELSE blocks || warns END, ',')) AS code FROM h)
SELECT cls, code, count(*) AS n FROM c WHERE code <> '' GROUP BY 1, 2""")
def q_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reasons stand in which class, the most frequent first."""
    return report.code_counts(_gated(spark, sf_dir).withColumn("codes", F.concat("gate.block_codes", "gate.warn_codes")))


@query(f"""WITH {_FIGURES_SQL} SELECT s_nationkey::VARCHAR AS pref, count(*) FILTER (cls = 'PASS') AS "PASS", count(*) FILTER (cls = 'WARN') AS "WARN", count(*) FILTER (cls = 'HOLD') AS "HOLD",
  count(*) FILTER (cls = 'FAIL') AS "FAIL", count(*) FILTER (cls = 'UNEVALUABLE') AS "UNEVALUABLE", count(*) AS total FROM h GROUP BY ROLLUP (s_nationkey)""")
def q_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes across, areas down, and a row of totals."""
    rows = _gated(spark, sf_dir).select(F.col("s_nationkey").cast("string").alias("pref"), "cls")
    return report.class_table(rows, ["PASS", "WARN", "HOLD", "FAIL", "UNEVALUABLE"])


@query("""SELECT l_suppkey AS dam_id, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'R') AS missing, count(*) FILTER (l_returnflag = 'Z') AS legacy_empty,
  CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'mixed' END AS method FROM lineitem WHERE l_partkey % 9 = l_suppkey % 9 GROUP BY 1""")
def q_tiles_and_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of each kind, zeros included, and the one method of a group or mixed."""
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 9 = l_suppkey % 9").withColumnRenamed("l_suppkey", "dam_id")
    kind = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "missing").when(F.col("l_returnflag") == "Z", "legacy_empty")
    counts = report.tile_counts(rows.withColumn("kind", kind))
    return counts.join(report.method_of(rows.withColumn("method", F.col("l_linestatus")), "dam_id", "method"), "dam_id")


@query("""WITH e AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_nationkey % 4 <> 0 GROUP BY 1) SELECT n_nationkey, n_nationkey * 7 % 25 AS ord, coalesce(n, 0) AS n FROM nation LEFT JOIN e ON c_nationkey = n_nationkey""")
def q_counts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every key of a registry, in its order."""
    registry = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 % 25).alias("ord"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 0 and c_nationkey % 4 <> 0").withColumnRenamed("c_nationkey", "n_nationkey")
    return report.counts_with_zeros(rows, "n_nationkey", registry)


@query("""WITH r AS (SELECT c_nationkey, c_mktsegment, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer) SELECT c_nationkey, c_custkey, place::INTEGER AS place FROM r WHERE place <= 12""")
def q_group_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve rows of every group by several keys."""
    return report.preview(table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment", "c_name", "c_custkey"], 12).select("c_nationkey", "c_custkey", "place")


# --- visits -----------------------------------------------------------------


def _visit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup file a user, some of them broken."""
    u, e = F.col("user_id"), F.col("event_id")
    each = table(spark, sf_dir, "events").where("event_type = 'view'").select(u, F.struct(
        F.when(e % 8 != 0, F.concat(F.lit("d"), e % 40)).alias("dam_id"), F.when(e % 9 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("visited_at"),
        F.concat(F.lit("n"), e).alias("note"), F.when(u % 10 == 4, "1.0").alias("lat")).alias("v"))
    files = each.groupBy("user_id").agg(F.array_sort(F.collect_list("v")).alias("visits"))  # a person's own visits
    body = F.to_json(F.struct(F.when(u % 10 == 1, "diary").otherwise(visits.TAG).alias("tag"), F.when(u % 10 == 2, 9).otherwise(visits.FORMAT).alias("format"), F.when(u % 10 != 3, F.col("visits")).alias("visits")))
    return files.select(u.cast("string").alias("path"), F.when(u % 10 == 5, "no json").otherwise(body).alias("body"))


@query("""WITH v AS (SELECT user_id, CASE WHEN event_id % 8 <> 0 THEN 'd' || (event_id % 40) END AS dam_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS seen, 'n' || event_id AS note FROM events WHERE event_type = 'view'),
good AS (SELECT * FROM v WHERE user_id % 10 NOT IN (1, 2, 3, 4, 5) AND dam_id IS NOT NULL AND seen IS NOT NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY dam_id ORDER BY seen, note) AS rn FROM good),
bad AS (SELECT DISTINCT user_id, CASE user_id % 10 WHEN 1 THEN 'other_file' WHEN 2 THEN 'newer_format' WHEN 3 THEN 'no_visits' WHEN 4 THEN 'forbidden_field' ELSE 'unreadable' END AS why FROM v WHERE user_id % 10 IN (1, 2, 3, 4, 5))
SELECT 'visit' AS part, dam_id AS key, strftime(seen, '%Y-%m-%d %H:%M:%S') AS visited, why FROM (SELECT dam_id, seen, NULL AS why FROM kept WHERE rn = 1 AND dam_id IN (SELECT 'd' || n_nationkey FROM nation))
UNION ALL SELECT 'rejected', user_id::VARCHAR, NULL, why FROM bad""")
def q_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups checked and merged: the earliest visit of every known dam, and why files were turned away."""
    good, bad = visits.validate(_visit_files(spark, sf_dir))
    merged = visits.merge(good.limit(0), good)
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("dam_id"))
    log = visits.newest_first(merged.join(known, "dam_id", "left_semi"))
    return log.select(F.lit("visit").alias("part"), F.col("dam_id").alias("key"), F.date_format("visited_at", "yyyy-MM-dd HH:mm:ss").alias("visited"), F.lit(None).cast("string").alias("why")).unionByName(
        bad.select(F.lit("rejected").alias("part"), F.col("path").alias("key"), F.lit(None).cast("string").alias("visited"), "why"))


# --- packed grids and schedules ---------------------------------------------


@query("""WITH c AS (SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k, CASE WHEN l_partkey % 9 = 8 THEN -1 ELSE l_partkey % 9 END AS d, l_quantity > 20 AS m FROM lineitem),
n AS (SELECT g, k // 2 AS b, string_agg(CASE d WHEN -1 THEN 'F' ELSE d::VARCHAR END, '' ORDER BY k) AS h FROM c GROUP BY 1, 2),
b AS (SELECT g, k // 8 AS b, sum(CASE WHEN m THEN 1 << (7 - k % 8)::INT ELSE 0 END)::BIGINT AS v FROM c GROUP BY 1, 2)
SELECT g, (SELECT string_agg(CASE WHEN length(h) = 1 THEN h || 'F' ELSE h END, '' ORDER BY b) FROM n WHERE n.g = x.g) AS d8, (SELECT string_agg(printf('%02X', v), '' ORDER BY b) FROM b WHERE b.g = x.g) AS mask FROM (SELECT DISTINCT g FROM c) x""")
def q_packed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions at four bits a cell and masks at one bit, packed by expressions."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    code = F.col("l_partkey") % 9
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.row_number().over(w) - 1).alias("k"), F.when(code == 8, -1).otherwise(code).alias("d"), (F.col("l_quantity") > 20).alias("m"))
    return grid.packed(cells, "g", "k", "d", "m").select("g", F.hex("d8").alias("d8"), F.hex("mask").alias("mask"))


@query("""SELECT c_custkey AS dam_id, oi, radius_m, i, j, acc FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey, radius_m ORDER BY acc DESC, i, j) AS rn FROM
  (SELECT c_custkey, c_custkey % 24 AS oi, c_custkey * 7 % 24 AS oj, 5.0 + c_custkey % 60 AS mpp FROM customer WHERE c_custkey <= 200) d,
  (SELECT unnest([50, 150, 250, 400, 700, 1000]) AS radius_m) r, (SELECT i, j, i * 31 % 17 + j * 13 % 23 AS acc FROM (SELECT unnest(range(24)) AS i), (SELECT unnest(range(24)) AS j)) c
  WHERE abs(i - oi) <= greatest(3, floor(radius_m / mpp)) AND abs(j - oj) <= greatest(3, floor(radius_m / mpp))) WHERE rn = 1""")
def q_outlet_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest cell within every radius of a profile."""
    k = F.col("c_custkey")
    dams = table(spark, sf_dir, "customer").where("c_custkey <= 200").select(k.alias("dam_id"), (k % 24).alias("oi"), (k * 7 % 24).alias("oj"), (F.lit(5.0) + k % 60).alias("mpp"))
    cells = spark.range(24).withColumnRenamed("id", "i").crossJoin(spark.range(24).withColumnRenamed("id", "j"))  # a fixed grid of 576 cells
    cells = dams.select("dam_id").crossJoin(cells.withColumn("acc", F.col("i") * 31 % 17 + F.col("j") * 13 % 23))  # every dam has its own copy
    found = profile.strongest_within(dams, cells)
    return found.join(dams.select("dam_id", "oi"), "dam_id").select("dam_id", "oi", "radius_m", "i", "j", "acc")


@query("""WITH RECURSIVE d AS (SELECT n_nationkey AS g, n_nationkey % 8 AS i0, n_nationkey * 3 % 8 AS j0 FROM nation),
t AS (SELECT g, 0 AS pos, i0 AS i, j0 AS j FROM d UNION ALL
  SELECT g, pos + 1, i + CASE WHEN c IN (7, 0, 1) THEN -1 WHEN c IN (3, 4, 5) THEN 1 ELSE 0 END, j + CASE WHEN c IN (1, 2, 3) THEN 1 WHEN c IN (5, 6, 7) THEN -1 ELSE 0 END
  FROM (SELECT *, (i * 5 + j * 3 + g) % 10 AS c FROM t) WHERE c <= 7 AND pos < 40
    AND i + CASE WHEN c IN (7, 0, 1) THEN -1 WHEN c IN (3, 4, 5) THEN 1 ELSE 0 END BETWEEN 0 AND 7 AND j + CASE WHEN c IN (1, 2, 3) THEN 1 WHEN c IN (5, 6, 7) THEN -1 ELSE 0 END BETWEEN 0 AND 7)
SELECT g, pos, i, j FROM t""")
def q_d8_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way down packed directions, 40 steps at most, by the table function."""
    tables.register(spark)
    g = F.col("n_nationkey")
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: (F.floor(x / 8) * 5 + x % 8 * 3 + g) % 10)
    nibbles = F.array_join(F.transform(every, lambda c: F.when(c > 7, "F").otherwise(c.cast("string"))), "")
    table(spark, sf_dir, "nation").select(g.alias("g"), F.unhex(nibbles).alias("d8"), (g % 8).cast("int").alias("i0"), (g * 3 % 8).cast("int").alias("j0")).createOrReplaceTempView("traced_grids")
    return spark.sql("SELECT g, t.pos, t.i, t.j FROM traced_grids, LATERAL d8_trace(d8, 8, 8, i0, j0, 40) t")


@query("""SELECT p_partkey, p_size * 37 AS side, (SELECT min(c) FROM range(1, 40) r(c) WHERE p_size * 37 // c <= 620) AS factor, (row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1) % 8 AS lane FROM part""")
def q_raster_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor by which a grid is coarsened, and the lane of each grid when the largest are dealt first."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("side"))
    return grid.dealt(rows.withColumn("factor", grid.coarse_factor(F.col("side"))), "side", "p_partkey", 8).select("p_partkey", "side", "factor", "lane")
