"""Mixing sources to target weights by Pfair scheduling.

Time is counted in slots of one block.  A source whose share of all weights is w / W has
block k released at floor(k * W / w) and due at ceil((k + 1) * W / w); the earliest
deadline among the released blocks takes each slot.  The shares fill every slot, so all
deadlines are met and after any number of slots a source is less than one block from
its target, whatever the number of sources.

The weights are integers, so the schedule repeats after W slots.  Only the table of
sources is scheduled in sequence, on the driver (a row a source, at most SLOTS slots);
the documents look their slot up.  Weights too fine for such a period are scheduled once
through, in blocks that are doubled until they are few enough.

Everything on the rows is DataFrame and SQL functions.  A source's documents are numbered
without a window over the source: md5 prefixes cut it into small ranges, whose counts are
summed in two levels, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots that the driver schedules at most.
SLOTS = 1 << 21
#: Documents of a block, and documents of one numbered range at most on average.
BLOCK, RANGE = 16, 256
#: Denominators of given weights at most.
FINEST = 10**6


def whole_weights(counts: list[tuple[str | None, int]], weights: Mapping[str, float] | None) -> list[int]:
    """Integer weights of the sources, without a common factor: the given ones, or the square root of the size, rounded up.

    A source that ``weights`` lacks takes the least of the given ones.
    """
    if weights is None:
        out = [math.isqrt(n - 1) + 1 for _, n in counts]
    else:
        parts = {k: Fraction(str(w)).limit_denominator(FINEST) for k, w in weights.items()}
        if any(p <= 0 for p in parts.values()):
            raise ValueError("weights must be positive, at least one millionth")
        least = min(parts.values(), default=Fraction(1))
        given = [parts.get(s, least) for s, _ in counts]
        common = math.lcm(*(p.denominator for p in given))
        out = [int(p * common) for p in given]
    factor = math.gcd(*out) or 1
    return [w // factor for w in out]


def earliest_deadlines(weights: list[int], blocks: list[int] | None = None) -> list[list[int]]:
    """Slots of each source's blocks: one period of sum(weights) slots, or only ``blocks`` blocks a source."""
    total = sum(weights)
    wanted = weights if blocks is None else blocks
    later = [(0, i, 0) for i, n in enumerate(wanted) if n]  # (release, source, block)
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    slots: list[list[int]] = [[] for _ in weights]
    t = 0
    while later or ready:
        if not ready and later[0][0] > t:
            t = later[0][0]  # sources that have run out leave their slots empty
        while later and later[0][0] <= t:
            _, i, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k))
        _, i, k = heapq.heappop(ready)
        slots[i].append(t)
        t += 1
        if k + 1 < wanted[i]:
            heapq.heappush(later, ((k + 1) * total // weights[i], i, k + 1))
    return slots


def _schedule(spark, counts: list, weights: Mapping[str, float] | None, block: int):
    """(block size, table of skey, w, all_w, period, slots): the slots of a period, or all slots with a period of null."""
    import pyarrow as pa

    sizes = [r["n"] for r in counts]
    w = whole_weights([(r["source"], r["n"]) for r in counts], weights) if counts else []
    period = sum(w)
    if period <= SLOTS:
        slots = earliest_deadlines(w)
    else:
        while sum(-(-n // block) for n in sizes) > max(SLOTS, len(sizes)):
            block *= 2
        slots = earliest_deadlines(w, [-(-n // block) for n in sizes])
    n = len(counts)
    table = pa.table({
        "skey": pa.array([r["skey"] for r in counts], pa.string()), "w": pa.array(w, pa.int64()), "all_w": pa.array([period] * n, pa.int64()),
        "period": pa.array([period if period <= SLOTS else None] * n, pa.int64()), "slots": pa.array(slots, pa.list_(pa.int64()))})
    return block, spark.createDataFrame(table)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, seed: str = "0",
        id_col: str = "doc_id", source_col: str = "source", spread: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with its place in the mix; also the names of the added columns.

    Added (a trailing _ is put on a name that ``docs`` has): block (number within the
    source), place (within the block), slot (order by slot, then place), release and
    deadline of the block, in slots.  ``weights`` maps sources to positive numbers (taken
    to a millionth), or is None for the square root of the source's size; a source it
    lacks takes the least of them.  No row is dropped or repeated: once a source has no
    blocks left its slots stay empty and the others keep their order.  A null source is
    a source of its own.  Rows without an id are spread, and rows of one id are ordered,
    by a hash of the columns ``spread`` (all of them unless named); rows that are equal
    there take neighbouring places in any order.  An empty table gives an empty result.
    """
    taken = docs.columns
    names = {n: _free(n, taken) for n in ("block", "place", "slot", "release", "deadline")}
    inner = {n: _free(f"mix_{n}", taken) for n in ("skey", "hash", "tie", "fine", "coarse", "from", "w", "all_w", "period", "slots")}
    skey = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("n"))
    # a row a source: the only rows that the driver sees
    counts = docs.groupBy(skey.alias("skey"), F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")).orderBy("skey").collect()
    digits = max(1, math.ceil(math.log(max(1, max((r["n"] for r in counts), default=1) / RANGE), 16)))
    block, schedule = _schedule(docs.sparkSession, counts, weights, block)

    tie = F.xxhash64(*[F.col(f"`{c}`") for c in (taken if spread is None else spread)])
    h = F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), tie.cast("string")))))
    rows = docs.withColumn(inner["tie"], tie).withColumn(inner["skey"], skey).withColumn(inner["hash"], h).withColumn(inner["fine"], F.substring(inner["hash"], 1, digits))
    ranges = rows.groupBy(F.col(inner["skey"]).alias("skey"), F.col(inner["fine"]).alias("fine"),
                          F.substring(inner["fine"], 1, digits // 2).alias("coarse")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("skey").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("skey", "coarse").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    coarse = ranges.groupBy("skey", "coarse").agg(F.sum("n").alias("n")).select("skey", "coarse", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    starts = ranges.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(coarse, ["skey", "coarse"]).select(
        F.col("skey").alias(inner["skey"]), F.col("fine").alias(inner["fine"]), (F.col("base") + F.col("inside")).alias(inner["from"]))
    order = Window.partitionBy(inner["skey"], inner["fine"]).orderBy(inner["hash"], F.col(id_col), inner["tie"])
    k = F.col(inner["from"]) + F.row_number().over(order) - 1
    # SLOTS integers in all, or a few rows a source
    table = F.broadcast(schedule.select(*[F.col(n).alias(inner[n]) for n in ("skey", "w", "all_w", "period", "slots")]))
    w, all_w, b = f"`{inner['w']}`", f"`{inner['all_w']}`", f"`{names['block']}`"
    slot = f"""if(`{inner['period']}` is null, get(`{inner['slots']}`, cast({b} as int)),
        {b} div {w} * `{inner['period']}` + get(`{inner['slots']}`, cast({b} % {w} as int)))"""
    # products beyond 64 bits are wide decimals: the windows stay exact
    wide = lambda x, y: f"cast({x} as decimal(20, 0)) * cast({y} as decimal(18, 0))"
    out = (
        rows.join(starts, [inner["skey"], inner["fine"]])
        .withColumn(names["place"], k)
        .join(table, inner["skey"])
        .withColumn(names["block"], F.expr(f"`{names['place']}` div {block}"))
        .withColumn(names["place"], (F.col(names["place"]) % block).cast("int"))
        .withColumn(names["slot"], F.expr(slot))
        .withColumn(names["release"], F.expr(f"cast({wide(b, all_w)} div {w} as bigint)"))
        .withColumn(names["deadline"], F.expr(f"cast(({wide(f'({b} + 1)', all_w)} + {w} - 1) div {w} as bigint)"))
    )
    return out.select(*[F.col(f"`{c}`") for c in taken], *names.values()), names


def plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source and the place of every document; ``docs`` is read without its texts."""
    rows, names = mix(docs.drop("text"), **options)
    return rows.select("doc_id", "source", *names.values())


def interleave(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mix order: ordered partitions, ordered rows, no added column.

    A table written from it has the order in its files; who reads them in parallel takes
    slot and place from :func:`mix` again, which is the same for the same rows.
    """
    rows, names = mix(docs, **options)
    keys = [names["slot"], names["place"]]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[F.col(f"`{c}`") for c in docs.columns])
