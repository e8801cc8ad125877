"""The registry of basin areas: its rules as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.functions.text import number, present

#: The numbers a row may carry and the states it may have.
NUMBERS, STATES = ("total_km2", "direct_km2", "indirect_km2"), ("confirmed", "unconfirmed")


def inferred_status(rows: DataFrame) -> Column:
    """The state as written; a blank one is confirmed where a direct or whole area is given."""
    given = present(F.col("direct_km2")).isNotNull() | present(F.col("total_km2")).isNotNull()
    return F.coalesce(present(F.col("basin_status")), F.when(given, "confirmed").otherwise("unconfirmed"))


def violations(rows: DataFrame, known: DataFrame, line: str = "line") -> DataFrame:
    """(line, rule) of every row that breaks a rule; an empty result means a valid registry.

    ``rows`` has line, dam_id, the texts of NUMBERS, basin_status, source and number_in_source.
    """
    rows = rows.withColumn("dam_id", present(F.col("dam_id"))).withColumn("state", inferred_status(rows))
    some = reduce(lambda a, b: a | b, [present(F.col(c)).isNotNull() for c in NUMBERS])
    tests = {f"{c}_no_number": present(F.col(c)).isNotNull() & number(F.col(c)).isNull() for c in NUMBERS}
    tests |= {f"{c}_negative": number(F.col(c)) < 0 for c in NUMBERS}
    confirmed = F.col("state") == "confirmed"
    tests |= {
        "no_id": F.col("dam_id").isNull(), "unknown_state": ~F.col("state").isin(*STATES), "number_unconfirmed": (F.col("state") == "unconfirmed") & some,
        "confirmed_without_number": confirmed & number(F.col("direct_km2")).isNull() & number(F.col("total_km2")).isNull(),
        "confirmed_without_source": confirmed & present(F.col("source")).isNull() & present(F.col("number_in_source")).isNull()}
    # one pass for all tests of a single row
    broken = F.array_compact(F.array(*[F.when(when, rule) for rule, when in tests.items()]))
    own = rows.select(line, F.explode(broken).alias("rule"))
    often = rows.where("dam_id is not null").groupBy("dam_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = rows.join(often.select("dam_id"), "dam_id", "left_semi").select(line, F.lit("repeated_id").alias("rule"))
    strange = rows.where("dam_id is not null").join(known.select("dam_id"), "dam_id", "left_anti").select(line, F.lit("unknown_id").alias("rule"))
    return own.unionByName(repeated).unionByName(strange)


def load(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Valid rows with numbers and state; a violation is an error that names the first of them."""
    bad = violations(rows, known).orderBy("line", "rule").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"line {r['line']}: {r['rule']}" for r in bad))
    return rows.select("dam_id", inferred_status(rows).alias("basin_status"), *[number(F.col(c)).alias(c) for c in NUMBERS], "source")
