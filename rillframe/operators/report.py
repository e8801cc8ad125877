"""Aggregate reports: coverage, classes, groups, review load, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(rows: DataFrame) -> DataFrame:
    """One row of totals and a map of reasons, over (cls, reason, other_ok): official, reference or none."""
    none = F.col("cls") == "none"
    total = rows.agg(F.count("*").alias("total"), F.count_if(~none).alias("shown"), F.count_if(F.col("cls") == "official").alias("official"),
                     F.count_if(F.col("cls") == "reference").alias("reference"), F.count_if(none).alias("dash"), F.count_if(none & F.col("other_ok")).alias("dash_with_other"))
    why = rows.where(none).groupBy(F.coalesce("reason", F.lit("other")).alias("reason")).agg(F.count("*").alias("n"))
    reasons = why.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return total.crossJoin(reasons)  # one row each


def counts_with_zeros(rows: DataFrame, by: str, registry: DataFrame) -> DataFrame:
    """Rows by key for every key of the registry, zeros included, in registry order."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return registry.join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("ord")


def class_table(rows: DataFrame, classes: list[str], by: str = "pref", cls: str = "cls") -> DataFrame:
    """Classes across, keys down, and a last row of totals."""
    return rows.rollup(by).agg(*[F.count_if(F.col(cls) == c).alias(c) for c in classes], F.count("*").alias("total")).orderBy(F.asc_nulls_last(by))


def code_counts(rows: DataFrame, codes: str = "codes", cls: str = "cls") -> DataFrame:
    """How often each reason occurs in each class, most frequent first."""
    return rows.select(cls, F.explode(codes).alias("code")).groupBy(cls, "code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), cls, "code")


def review_load(rows: DataFrame, flag: str = "human") -> DataFrame:
    """Rows to review and their share in percent with one decimal."""
    return rows.agg(F.count_if(flag).alias("review"), F.count("*").alias("total")).withColumn(
        "pct", F.round(F.try_divide(F.col("review") * 100.0, F.col("total")), 1))


def tile_counts(tiles: DataFrame, by: str = "dam_id") -> DataFrame:
    """Tiles of each kind, zeros included."""
    return tiles.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("ok", "missing", "legacy_empty")])


def method_of(rows: DataFrame, by: str, method: str) -> DataFrame:
    """The one method of a group, or mixed."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_set(method)).alias("m")).select(by, F.when(F.size("m") == 1, F.col("m")[0]).when(F.size("m") > 1, "mixed").alias(method))


def preview(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of every group in the order of several keys, with their place."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
