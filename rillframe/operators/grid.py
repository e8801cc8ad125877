"""Relational raster operators over cells (grid, i, j, z).

Neighbours are found by an equi join on shifted coordinates; flow paths by pointer
doubling, so a path of length L takes log2 L joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The eight directions clockwise from north as (row, column) steps, and the diagonal's length.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
DIAGONAL = 1.4142


def _steps(items) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(1.0 if di == 0 or dj == 0 else DIAGONAL).alias("far")) for k, (di, dj) in enumerate(items)])


def neighbours(cells: DataFrame, steps=STEPS, by: tuple[str, ...] = ()) -> DataFrame:
    """Each cell with each present neighbour: i, j, z, k, far, ni, nj, nz; ``by`` are columns that tell grids apart, here and below."""
    a = cells.select(*by, "i", "j", "z", F.explode(_steps(steps)).alias("s")).select(
        *by, "i", "j", "z", "s.k", "s.far", (F.col("i") + F.col("s.di")).alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj"))
    return a.join(cells.select(*by, F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("z").alias("nz")), [*by, "ni", "nj"])


def d8(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, d): the steepest falling direction, the first of equals, -1 if nothing falls."""
    drop = (F.col("z") - F.col("nz")) / F.col("far")
    best = neighbours(cells, by=by).where(F.col("nz") < F.col("z")).groupBy(*by, "i", "j").agg(F.max(F.struct(drop.alias("drop"), (-F.col("k")).alias("nk"))).alias("b"))
    return cells.join(best, [*by, "i", "j"], "left").select(*by, "i", "j", F.coalesce(-F.col("b.nk"), F.lit(-1)).cast("int").alias("d"))


def next_cell(directions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, ni, nj): where each cell drains to; cells without direction are left out."""
    table = _steps(STEPS)
    return directions.where("d >= 0").select(*by, "i", "j", F.element_at(table, F.col("d") + 1).alias("s")).select(
        *by, "i", "j", (F.col("i") + F.col("s.di")).alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj"))


def pointers(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, next) of every cell: node is a struct of grid, row and column, next is null where a way ends."""
    ways = next_cell(d8(cells, by), by)
    return cells.select(*by, "i", "j").join(ways, [*by, "i", "j"], "left").select(
        F.struct(*by, "i", "j").alias("node"), F.when(F.col("ni").isNotNull(), F.struct(*by, F.col("ni").alias("i"), F.col("nj").alias("j"))).alias("next"))


def _ahead(now: DataFrame) -> DataFrame:
    return now.select(F.col("node").alias("next"), F.col("next").alias("far"))


def accumulate(ways: DataFrame, checkpoint) -> DataFrame:
    """(node, acc): how many cells drain through each cell of (node, next), itself included.

    After a round a cell counts the cells less than 2**rounds steps above it, and its pointer
    is as far ahead: a path of length L takes log2 L rounds over as many rows as there are cells.
    """
    now = checkpoint(ways.select("node", "next", F.lit(1).cast("bigint").alias("acc")))
    while now.where("next is not null").limit(1).count():
        come = now.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.sum("acc").alias("come"))
        more = now.join(come, "node", "left").select("node", "next", (F.col("acc") + F.coalesce("come", F.lit(0))).alias("acc"))
        now = checkpoint(more.join(_ahead(now), "next", "left").select("node", F.col("far").alias("next"), "acc"))
    return now.select("node", "acc")


def upstream(ways: DataFrame, seeds: DataFrame, checkpoint) -> DataFrame:
    """(node): the cells of (node, next) whose way meets a seed, seeds included; in log2 rounds as :func:`accumulate`."""
    marked = seeds.select("node").distinct().withColumn("meets", F.lit(True))
    now = checkpoint(ways.join(marked, "node", "left").select("node", "next", F.coalesce("meets", F.lit(False)).alias("meets")))
    while now.where("next is not null").limit(1).count():
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("meets").alias("later"))
        now = checkpoint(now.join(ahead, "next", "left").select("node", F.col("far").alias("next"), (F.col("meets") | F.coalesce("later", F.lit(False))).alias("meets")))
    return now.where("meets").select("node")


def local_range(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, spread): highest minus lowest of the 3 x 3 cells around; cells at the border are left out."""
    every = neighbours(cells, (*STEPS, (0, 0)), by)
    return every.groupBy(*by, "i", "j").agg((F.max("nz") - F.min("nz")).alias("spread"), F.count("*").alias("n")).where("n = 9").drop("n")


def block_mean(cells: DataFrame, c: int, height: int, width: int) -> DataFrame:
    """Means of c x c blocks without NaN; a ragged edge is dropped, a block of NaN alone is null."""
    inside = cells.where((F.col("i") < height // c * c) & (F.col("j") < width // c * c))
    return inside.groupBy(F.expr(f"i div {c}").alias("bi"), F.expr(f"j div {c}").alias("bj")).agg(F.avg(F.when(~F.isnan(F.col("z").cast("double")), F.col("z"))).alias("mean"))


def block_majority(mask: DataFrame, c: int) -> DataFrame:
    """(bi, bj, most, any_in): whether at least half of a block is in the mask, and whether anything is."""
    return mask.groupBy(F.expr(f"i div {c}").alias("bi"), F.expr(f"j div {c}").alias("bj")).agg(
        (F.sum(F.col("m").cast("int")) * 2 >= c * c).alias("most"), F.bool_or("m").alias("any_in"))


def dilate(cells: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Cells within k rows and columns of the given ones, inside the grid."""
    span = F.sequence(F.lit(-k), F.lit(k))
    grown = cells.select("i", "j", F.explode(span).alias("di")).select((F.col("i") + F.col("di")).alias("i"), "j", F.explode(span).alias("dj")).select("i", (F.col("j") + F.col("dj")).alias("j"))
    return grown.where(F.col("i").between(0, height - 1) & F.col("j").between(0, width - 1)).distinct()


def doubled(pointers: DataFrame, rounds: int, checkpoint) -> DataFrame:
    """Pointer doubling of (node, next, carry): after the rounds next is 2**rounds steps ahead (or the end) and carry is the OR of the path.

    Ends point to themselves.  ``checkpoint`` cuts the lineage of a round.
    """
    now = pointers
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("carry").alias("more"))
        now = checkpoint(now.join(ahead, "next").select("node", F.col("far").alias("next"), (F.col("carry") | F.col("more")).alias("carry")))
    return now


def components(cells: DataFrame, checkpoint, rounds: int = 64) -> DataFrame:
    """(i, j, label): eight-connected components by the smallest key; labels jump to their label's label each round."""
    key = F.col("i").cast("bigint") * (1 << 31) + F.col("j")
    flat = cells.select("i", "j", key.alias("z"))
    links = checkpoint(neighbours(flat).select(F.col("z").alias("node"), F.col("nz").alias("other")))
    labels = flat.select(F.col("z").alias("node"), F.col("z").alias("label"))
    for _ in range(rounds):
        seen = links.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        then = checkpoint(lower.join(jump, "low").select("node", F.col("label").alias("old"), F.col("next").alias("label")))
        changed = then.where("old <> label").limit(1).count()
        labels = then.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return flat.join(labels, flat["z"] == labels["node"]).select("i", "j", "label")


def minimax_fill(cells: DataFrame, checkpoint, rounds: int = 400) -> DataFrame:
    """(i, j, fill): the lowest level at which water from the cell reaches the border."""
    edge = cells.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    border = (F.col("i") == edge[0]) | (F.col("i") == edge[1]) | (F.col("j") == edge[2]) | (F.col("j") == edge[3])
    now = checkpoint(cells.select("i", "j", "z", F.when(border, F.col("z")).alias("fill")))
    for _ in range(rounds):
        low = neighbours(now.select("i", "j", F.col("fill").alias("z"))).groupBy("i", "j").agg(F.min("nz").alias("way"))
        level = F.when(F.col("way").isNull(), F.col("fill")).otherwise(F.least("fill", F.greatest("z", "way")))
        then = checkpoint(now.join(low, ["i", "j"], "left").select("i", "j", "z", F.col("fill").alias("old"), level.alias("fill")))
        changed = then.where(~F.col("old").eqNullSafe(F.col("fill"))).limit(1).count()
        now = then.drop("old")
        if not changed:
            return now.select("i", "j", "fill")
    raise RuntimeError("the fill did not settle")


def path_positions(paths: DataFrame, path: str, pos: str, step: str) -> DataFrame:
    """Distance travelled before each position."""
    w = Window.partitionBy(path).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paths.withColumn("travelled", F.sum(step).over(w) - F.col(step))


def packed(cells: DataFrame, grid: str, place: str, direction: str, inside: str) -> DataFrame:
    """(grid, d8, mask): directions at four bits a cell, high half first, 15 for none and for the odd last half; a mask at one bit, the first cell highest.

    Cells are packed to bytes by groups first, so that a grid is joined from its bytes.
    """
    nibble = F.when(F.col(direction) < 0, 15).otherwise(F.col(direction)).cast("int")
    eight = F.floor(F.col(place) / 8)
    byte = cells.groupBy(grid, eight.alias("b")).agg(
        F.sum(F.when(F.col(inside), F.call_function("shiftleft", F.lit(1), (F.lit(7) - F.col(place) % 8).cast("int"))).otherwise(0)).alias("bits"),
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), nibble.alias("n")))).alias("ns"))  # eight cells
    halves = F.array_join(F.transform("ns", lambda x: F.hex(x["n"])), "")
    halves = F.when(F.size("ns") % 2 == 1, F.concat(halves, F.lit("F"))).otherwise(halves)
    parts = byte.select(grid, F.struct("b", halves.alias("d"), F.lpad(F.hex(F.col("bits")), 2, "0").alias("m")).alias("p"))
    whole = parts.groupBy(grid).agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the bytes of one grid
    join = lambda f: F.unhex(F.array_join(F.transform("ps", lambda x: x[f]), ""))
    return whole.select(grid, join("d").alias("d8"), join("m").alias("mask"))


def coarse_factor(side: Column, most: int = 620) -> Column:
    """The smallest factor that brings a side down to at most ``most`` whole blocks."""
    return F.greatest(F.lit(1), F.floor(side / F.lit(most + 1)) + 1).cast("int")


def dealt(grids: DataFrame, size: str, key: str, lanes: int) -> DataFrame:
    """Grids with a lane: the largest are dealt first, one to each lane in turn, so no lane ends with a large one."""
    order = Window.orderBy(F.desc(size), key)  # a row a grid
    return grids.withColumn("lane", (F.row_number().over(order) - 1) % lanes)
