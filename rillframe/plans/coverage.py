"""Measurements, display coverage and reasons over ``events`` (operators P1-P8, A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.operators import measure
from rillframe.plans.tables import table


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a quality code and a raw reading, normalised to a measurement."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts",
        (F.get_json_object("props", "$.k").cast("int") * 2).alias("ccd"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("raw"),
    )
    return events.withColumn("m", measure.normalize("raw", "ccd"))


MEASURED_SQL = """measured AS (
  SELECT event_id, user_id, event_type, ts, ccd, raw,
         CASE WHEN ccd = 190 THEN 'missing' WHEN ccd = 140 THEN 'closed'
              WHEN ccd IS NULL OR ccd >= 130 THEN 'not_provided'
              WHEN raw IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM (SELECT event_id, user_id, event_type, ts,
               2 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS ccd,
               CASE WHEN event_id % 7 <> 0 THEN value END AS raw FROM events))"""


def q_measure_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select(
        "event_id", F.col("m.value").alias("value"), F.col("m.status").alias("status"), F.col("m.reason").alias("reason"),
    )


def q_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown officially, shown by reference, or not shown, per event type."""
    rows = measured(spark, sf_dir).withColumn("calc_ok", F.col("event_id") % 3 == 0)
    cls = measure.coverage_class(F.col("m.status"), F.col("calc_ok"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("total"),
        F.count_if(cls != "none").alias("shown"),
        F.count_if(cls == "official").alias("official"),
        F.count_if(cls == "reference").alias("reference"),
        F.count_if(cls == "none").alias("dash"),
    )


def q_reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).where((F.col("m.status") != "ok") & (F.col("event_id") % 3 != 0))
    return rows.groupBy("event_type", F.col("m.status").alias("status")).agg(F.count("*").alias("n"))


QUERIES = {
    "q_measure_normalize": q_measure_normalize,
    "q_coverage_summary": q_coverage_summary,
    "q_reason_breakdown": q_reason_breakdown,
}

ORACLES = {
    "q_measure_normalize": f"""WITH {MEASURED_SQL}
SELECT event_id, CASE WHEN status = 'ok' THEN raw END AS value, status,
       CASE status WHEN 'missing' THEN 'no reading in this slot' WHEN 'closed' THEN 'station closed'
            WHEN 'not_provided' THEN 'not provided by the source' END AS reason FROM measured""",
    "q_coverage_summary": f"""WITH {MEASURED_SQL},
c AS (SELECT event_type, CASE WHEN status = 'ok' THEN 'official' WHEN event_id % 3 = 0 THEN 'reference' ELSE 'none' END AS cls FROM measured)
SELECT event_type, count(*) AS total, count(*) FILTER (cls <> 'none') AS shown, count(*) FILTER (cls = 'official') AS official,
       count(*) FILTER (cls = 'reference') AS reference, count(*) FILTER (cls = 'none') AS dash FROM c GROUP BY 1""",
    "q_reason_breakdown": f"""WITH {MEASURED_SQL}
SELECT event_type, status, count(*) AS n FROM measured WHERE status <> 'ok' AND event_id % 3 <> 0 GROUP BY 1, 2""",
}
