"""Caches, stale answers, late answers, samples, delimited parts and published forms."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators import relate, select


def cached_or_fetched(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, now, days: int = 30, key: str = "code") -> DataFrame:
    """The cache after a refresh, with ``saved_at``: young entries stay, what was fetched replaces the old, the rest goes.

    ``wanted`` names the keys that are in use; entries of others are dropped.
    """
    young = select.fresh(cache, now, days)
    new = fetched.withColumn("saved_at", F.lit(now).cast(cache.schema["saved_at"].dataType))
    return relate.overwrite(young, new.select(*cache.columns), key).join(wanted.select(key).distinct(), key, "left_semi")


def to_fetch(wanted: DataFrame, cache: DataFrame, now, days: int = 30, key: str = "code") -> DataFrame:
    """Keys in use without a young entry."""
    return wanted.select(key).distinct().join(select.fresh(cache, now, days), key, "left_anti")


def network_first(answers: DataFrame, kept: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, stale): the answer, else the kept copy, marked stale; a kept copy of a key that wasn't asked for stays."""
    both = answers.select(key, F.col(value).alias("now")).join(kept.select(key, F.col(value).alias("old")), key, "full_outer")
    return both.select(key, F.coalesce("now", "old").alias(value), F.col("now").isNull().alias("stale")).where(F.col(value).isNotNull())


def not_overtaken(answers: DataFrame, by: str, epoch: str, arrival: str) -> DataFrame:
    """Answers that weren't overtaken: none of a later epoch had arrived before."""
    before = Window.partitionBy(by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return answers.withColumn("seen_", F.max(epoch).over(before)).where(F.col("seen_").isNull() | (F.col(epoch) >= F.col("seen_"))).drop("seen_")


def sampled(cells: DataFrame, grids: DataFrame, grid: str, most: int, seed: str) -> DataFrame:
    """(grid, i, j): up to ``most`` cells of each grid (grid, oi, oj) in the order of a keyed hash; the outlet where a grid has no cell.

    The same seed gives the same cells wherever and whenever it runs.
    """
    h = F.md5(F.concat_ws("-", F.lit(seed), grid, "i", "j"))
    pick = cells.withColumn("n_", F.row_number().over(Window.partitionBy(grid).orderBy(h, "i", "j"))).where(F.col("n_") <= most).select(grid, "i", "j")
    return grids.join(pick, grid, "left").select(grid, F.coalesce("i", "oi").alias("i"), F.coalesce("j", "oj").alias("j"))


def touching_tiles(cells: DataFrame, kinds: DataFrame, grid: str, side: int = 256) -> DataFrame:
    """(grid, x, y, kind) of the tiles that aren't ok and hold a cell of the grid or of its rim; cells count from the first tile.

    A cell and its eight neighbours fall into tiles by integer division, so the join is by key.
    """
    step = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # only cells at a tile's rim have neighbours in another tile: folded before the join
    tiles = cells.select(grid, "i", "j", F.explode(step).alias("d")).select(
        grid, F.floor((F.col("j") + F.col("d.dj")) / side).alias("x"), F.floor((F.col("i") + F.col("d.di")) / side).alias("y")).distinct()
    return kinds.where("kind <> 'ok'").join(tiles, [grid, "x", "y"], "left_semi")


def verified(candidates: DataFrame, ends: DataFrame, goals: DataFrame, key: str, grid: str) -> DataFrame:
    """Candidates (key, grid) whose way in the grid ends at one of its goals: ``ends`` has key, grid, i, j and ``goals`` grid, i, j."""
    reached = ends.join(goals, [grid, "i", "j"], "left_semi")
    return candidates.join(reached.select(key, grid), [key, grid], "left_semi")


def replaced_between(body: Column, begin: str, end: str, new: Column) -> Column:
    """The text with what stands between two markers replaced; an error where the markers aren't there once each, in order."""
    start, stop = F.instr(body, begin), F.instr(body, end)
    count = lambda m: (F.length(body) - F.length(F.replace(body, F.lit(m), F.lit("")))) / len(m)
    good = (count(begin) == 1) & (count(end) == 1) & (start < stop)
    put = F.concat(F.substring(body, F.lit(1), start + F.lit(len(begin) - 1)), new, F.substring(body, stop, F.length(body)))
    return F.when(good, put).otherwise(F.raise_error(F.concat(F.lit("markers: "), F.lit(begin))))


def linked_data(kind: str, **fields: Column) -> Column:
    """A JSON-LD record; absent fields are left out."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(n) for n, c in fields.items()]))


def settings(text: str, defaults: dict) -> dict:
    """Settings over their defaults; keys that begin with an underscore are remarks, an unknown key is an error."""
    given = {k: v for k, v in json.loads(text or "{}").items() if not k.startswith("_")}
    if unknown := sorted(set(given) - set(defaults)):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def resumed(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], groups: int = 8) -> DataFrame:
    """The results of ``work`` over all of ``todo``, appended to ``path`` group by group; what is there is not done again.

    A run that breaks off keeps its finished groups, and the next one goes on with the rest.
    """
    spark = todo.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    for n in range(groups):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(groups)) == n)
        if there:
            part = part.join(spark.read.parquet(path).select(key), key, "left_anti")
        if part.limit(1).count():
            work(part).write.mode("append").parquet(path)
            there = True
    return spark.read.parquet(path)
