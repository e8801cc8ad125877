"""Caches, late and stale answers, samples, tiles in contact, routed candidates and published forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import tables
from rillframe.operators import upkeep
from rillframe.plans.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
NOW = dt.datetime(2024, 2, 1)


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 3 != 0).select(
        k.alias("code"), F.col("s_name").alias("master"), F.timestamp_add("DAY", (k % 60).cast("int"), F.lit("2023-12-20").cast("timestamp")).alias("saved_at"))


_CACHE_SQL = "c AS (SELECT s_suppkey AS code, s_name AS master, TIMESTAMP '2023-12-20' + to_days((s_suppkey % 60)::INTEGER) AS saved_at FROM supplier WHERE s_suppkey % 3 <> 0)"


@query(f"""WITH {_CACHE_SQL}, y AS (SELECT * FROM c WHERE TIMESTAMP '2024-02-01' - INTERVAL 30 DAY < saved_at), f AS (SELECT s_suppkey AS code, 'new ' || s_suppkey AS master FROM supplier WHERE s_suppkey % 5 = 0)
SELECT code, coalesce(f.master, y.master) AS master, strftime(CASE WHEN f.code IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE saved_at END, '%Y-%m-%d') AS saved FROM y FULL JOIN f USING (code) WHERE code IN (SELECT c_custkey % 80 FROM customer)""")
def q_master_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station masters kept after a refresh."""
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 80).alias("code"))
    fetched = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("code"), F.concat(F.lit("new "), "s_suppkey").alias("master"))
    return upkeep.cached_or_fetched(wanted, _cache(spark, sf_dir), fetched, NOW).select("code", "master", F.date_format("saved_at", "yyyy-MM-dd").alias("saved"))


@query(f"WITH {_CACHE_SQL} SELECT DISTINCT c_custkey % 80 AS code FROM customer WHERE c_custkey % 80 NOT IN (SELECT code FROM c WHERE TIMESTAMP '2024-02-01' - INTERVAL 30 DAY < saved_at)")
def q_masters_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 80).alias("code"))
    return upkeep.to_fetch(wanted, _cache(spark, sf_dir), NOW)


@query("""WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 GROUP BY 1), k AS (SELECT user_id, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, coalesce(a.v, k.v) AS value, a.v IS NULL AS stale FROM a FULL JOIN k USING (user_id)""")
def q_stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of now, else the kept one, marked stale."""
    events = table(spark, sf_dir, "events")
    answers = events.where("event_type = 'purchase' and user_id % 3 <> 0").groupBy("user_id").agg(F.max("value").alias("value"))
    return upkeep.network_first(answers, events.where("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("value")), "user_id", "value")


@query("""SELECT event_id, epoch FROM (SELECT event_id, event_id * 7 % 13 AS epoch, max(event_id * 7 % 13) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE seen IS NULL OR epoch >= seen""")
def q_not_overtaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that no later request had overtaken."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 7 % 13).alias("epoch"))
    return upkeep.not_overtaken(rows, "user_id", "epoch", "event_id").select("event_id", "epoch")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS g, l_partkey % 24 AS i, l_orderkey % 24 AS j FROM lineitem WHERE l_suppkey % 4 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('rain-' || g || '-' || i || '-' || j), i, j) AS n FROM c)
SELECT s_suppkey AS g, coalesce(i, s_suppkey % 5) AS i, coalesce(j, 3) AS j FROM supplier LEFT JOIN p ON g = s_suppkey AND n <= 5""")
def q_sampled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cells of every grid by a keyed hash, its outlet where there is none."""
    cells = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 24).alias("i"), (F.col("l_orderkey") % 24).alias("j")).distinct()
    grids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("g"), (F.col("s_suppkey") % 5).alias("oi"), F.lit(3).cast("bigint").alias("oj"))
    return upkeep.sampled(cells, grids, "g", 5, "rain")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS g, l_partkey % 90 AS i, l_orderkey % 90 AS j FROM lineitem), o AS (SELECT unnest([-1, 0, 1]) AS d),
t AS (SELECT DISTINCT g, floor((j + b.d) / 16)::BIGINT AS x, floor((i + a.d) / 16)::BIGINT AS y FROM c, o a, o b),
k AS (SELECT s_suppkey AS g, x, y, CASE (s_suppkey + x * 3 + y) % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'legacy_empty' ELSE 'ok' END AS kind FROM supplier, (SELECT unnest(range(-1, 8)) AS x), (SELECT unnest(range(-1, 8)) AS y))
SELECT k.* FROM k SEMI JOIN t USING (g, x, y) WHERE kind <> 'ok'""")
def q_touching_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that aren't whole and touch a catchment."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 90).alias("i"), (F.col("l_orderkey") % 90).alias("j")).distinct()
    span = F.sequence(F.lit(-1).cast("bigint"), F.lit(7).cast("bigint"))
    tiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("g"), F.explode(span).alias("x")).withColumn("y", F.explode(span))
    kind = (F.col("g") + F.col("x") * 3 + F.col("y")) % 4
    return upkeep.touching_tiles(cells, tiles.withColumn("kind", F.when(kind == 0, "missing").when(kind == 1, "legacy_empty").otherwise("ok")), "g", 16)


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS dam, c_custkey % 25 AS g FROM customer WHERE c_custkey % 3 <> 0),
t AS (SELECT dam, g, 0 AS pos, dam % 8 AS i, dam * 5 % 8 AS j FROM c UNION ALL
  SELECT dam, g, pos + 1, i + CASE WHEN d IN (7, 0, 1) THEN -1 WHEN d IN (3, 4, 5) THEN 1 ELSE 0 END, j + CASE WHEN d IN (1, 2, 3) THEN 1 WHEN d IN (5, 6, 7) THEN -1 ELSE 0 END
  FROM (SELECT *, (i * 5 + j * 3 + g) % 10 AS d FROM t) WHERE d <= 7 AND pos < 40
    AND i + CASE WHEN d IN (7, 0, 1) THEN -1 WHEN d IN (3, 4, 5) THEN 1 ELSE 0 END BETWEEN 0 AND 7 AND j + CASE WHEN d IN (1, 2, 3) THEN 1 WHEN d IN (5, 6, 7) THEN -1 ELSE 0 END BETWEEN 0 AND 7),
e AS (SELECT dam, g, arg_max(i, pos) AS i, arg_max(j, pos) AS j FROM t GROUP BY 1, 2)
SELECT dam, g FROM e WHERE (i + j) % 2 = 0""")
def q_routed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose way in the other's grid ends at one of its goals."""
    tables.register(spark)
    k, g = F.col("c_custkey"), F.col("n_nationkey")
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: (F.floor(x / 8) * 5 + x % 8 * 3 + g) % 10)
    grids = table(spark, sf_dir, "nation").select(g.cast("bigint").alias("g"), F.unhex(F.array_join(F.transform(every, lambda c: F.when(c > 7, "F").otherwise(c.cast("string"))), "")).alias("d8"))
    candidates = table(spark, sf_dir, "customer").where(k % 3 != 0).select(k.alias("dam"), (k % 25).alias("g"))
    candidates.join(grids, "g").select("dam", "g", "d8", (F.col("dam") % 8).cast("int").alias("i0"), (F.col("dam") * 5 % 8).cast("int").alias("j0")).createOrReplaceTempView("routed_grids")
    walked = spark.sql("SELECT dam, g, t.pos, t.i, t.j FROM routed_grids, LATERAL d8_trace(d8, 8, 8, i0, j0, 40) t")
    ends = walked.groupBy("dam", "g").agg(F.max_by(F.struct("i", "j"), "pos").alias("e")).select("dam", "g", "e.i", "e.j")
    cells = grids.select("g", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return upkeep.verified(candidates, ends, cells.where("(i + j) % 2 = 0"), "dam", "g")


@query("""SELECT page_id, regexp_replace(html, '<title>.*?</title>', '<title>page ' || page_id || '</title>', 's') AS html FROM pages
WHERE length(html) - length(replace(html, '<title>', '')) = 7 AND length(html) - length(replace(html, '</title>', '')) = 8""")
def q_replaced_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the text between two markers replaced."""
    once = lambda m: F.length("html") - F.length(F.replace(F.col("html"), F.lit(m), F.lit(""))) == len(m)
    rows = table(spark, sf_dir, "pages").where(once("<title>") & once("</title>"))
    return rows.select("page_id", upkeep.replaced_between(F.col("html"), "<title>", "</title>", F.concat(F.lit("page "), "page_id")).alias("html"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"@context":"https://schema.org","@type":"Place","name":"' || s_name || '","url":"/dam/' || s_suppkey || '"}'
  ELSE '{"@context":"https://schema.org","@type":"Place","name":"' || s_name || '"}' END AS record FROM supplier""")
def q_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that a page carries for search engines."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, upkeep.linked_data("Place", name=F.col("s_name"), url=F.when(k % 2 == 0, F.concat(F.lit("/dam/"), k))).alias("record"))
