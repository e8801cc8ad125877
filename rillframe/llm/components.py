"""Connected components of an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to u's smallest neighbour (u itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.join(low, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    tied = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
    return tied.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is its smallest node.

    Sums over a node's neighbours are combined before the shuffle and joined back,
    so a hub with very many neighbours is split by AQE's skew join.  Each round is
    written to the shared folder; only one count goes to the driver.  Self loops,
    nulls and repeated edges are allowed; a self loop alone gives no row.
    """
    now = ws.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for i in range(1, rounds + 1):
        # stars only: no smaller end is itself a larger end, and each larger end has one smaller end
        state = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("heads")).first()
        if state["n"] == 0:
            break
        if state["n"] == state["heads"] and now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi").limit(1).count() == 0:
            break
        then = ws.keep(_small_star(_large_star(now).distinct()), f"{name}-{i}")
        ws.drop(f"{name}-{i - 1}")
        now = then
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
