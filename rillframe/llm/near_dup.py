"""Near-duplicate groups: SimHash tiles find candidates, exact Jaccard decides.

Documents whose distinct shingles are the same set form one item.  The tiles compare
all items whose sizes allow the similarity and whose fingerprints lie within a radius
that near copies don't leave (a similarity of 0.8 means 9.7 differing bits on average
with a deviation of 2.9); a sketch of one byte a bin, compared in the same task, stands
in for the similarity there, so that each pair of blocks sends a spanning forest of its
most similar pairs and not all pairs of a group.  Every pair of the forest is then
checked on the full shingle sets.  Candidates that the checked links leave in different
groups are compared once more: the full sets of their items meet in one task for each
pair of blocks, so no candidate stays unverified behind a pair that failed.

Fingerprints are taken over distinct shingles, as the similarity is.  Of two short sets
few bits are settled by a clear majority, so sets of up to SHORT shingles and their
partners take an exact second route: similar sets share a shingle among the first few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, row_binaries, texts_of
from rillframe.llm.components import connected_components
from rillframe.llm.simhash import Tiling, fingerprint, link_items, open_items, shingle_hashes, sketch, words_of

WIDTH, SIMILARITY = 5, 0.8
#: Differing bits of a candidate, and how far below the similarity its sketch may lie (3 deviations of 128 bins).
RADIUS, MARGIN = 18, 0.11
#: Distinct shingles of a set whose links are found without fingerprints; items that meet in one task.
SHORT, MEET = 40, 2048

ITEM_SCHEMA = "doc_id bigint, digest bigint, fp bigint, sketch binary, size bigint, short binary"


def signed(x: int) -> int:
    """The signed 64-bit integer with the same bits."""
    return x - (1 << 64) if x >> 63 else x


def _describe(width: int, short: float):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for view in row_binaries(batch.column(1)):
                own = np.unique(shingle_hashes(words_of(view), width))
                rows.append((signed(xxh64_intdigest(own.tobytes())), signed(fingerprint(own)), sketch(own), len(own), own.tobytes() if len(own) <= short else None))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            cols = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                  names=["doc_id", "digest", "fp", "sketch", "size", "short"])

    return run


def _sets(width: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(v), width)).tobytes() for v in row_binaries(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["item", "own"])

    return run


def _verify(least: float):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            left, right = row_binaries(batch.column(2)), row_binaries(batch.column(3))
            good = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


#: Shingles of one set that are looked up at once.
PIECE = 2048


def exact_links(ids, groups, sets, ids2, groups2, sets2, least: float) -> list[tuple[int, int]]:
    """Links (Jaccard of at least ``least``) from the first items to the second that join groups: a spanning forest of all such links."""
    _, label = np.unique(np.append(groups, groups2), return_inverse=True)
    la, lb = label[:len(ids)].copy(), label[len(ids):].copy()
    sizes = np.array([len(s) for s in sets2])
    hot, out = np.bincount(label).argmax(), []
    # pairs inside the largest group need no look
    for rows, cols in ((la == hot, lb != hot), (la != hot, np.ones(len(lb), bool))):
        at, cols = np.nonzero(rows)[0], np.nonzero(cols)[0]
        if not len(at) or not len(cols):
            continue
        flat, owner = np.concatenate([sets2[j] for j in cols]), np.repeat(cols, sizes[cols])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i in at.tolist():
            if (lb[cols] == la[i]).all():
                continue
            both = np.zeros(len(lb), np.int64)
            for k in range(0, len(sets[i]), PIECE):
                some = sets[i][k:k + PIECE]
                low = np.searchsorted(flat, some, "left")
                n = np.searchsorted(flat, some, "right") - low
                both += np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(lb))
            good = (both >= least * (len(sets[i]) + sizes - both) - 1e-9) & (both > 0)
            for j in np.nonzero(good & (lb != la[i]))[0].tolist():
                old, new = lb[j], la[i]
                if old != new:
                    out.append((int(ids[i]), int(ids2[j])))
                    la[la == old] = new
                    lb[lb == old] = new
    return out


def _side(rows) -> tuple:
    """(ids, groups, sets) of an Arrow list of (item, grp, own)."""
    ids, groups = (rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("item", "grp"))
    return ids, groups, [np.frombuffer(v, np.uint64) for v in row_binaries(rows.field("own"))]


def _exact(least: float):
    """Rows (left, right) of arrays of (item, grp, own) to the links that join groups."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                out += exact_links(*_side(batch.column(0)[r].values), *_side(batch.column(1)[r].values), least)
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _prefixes(least: float):
    """(item, grp, own) to a row for each of the smallest shingles, one of which every partner shares."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [np.frombuffer(v, np.uint64) for v in row_binaries(batch.column(2))]
            firsts = [s[:len(s) - math.ceil(least * len(s) - 1e-9) + 1] if len(s) else s for s in sets]
            at = np.repeat(np.arange(len(sets)), [len(f) for f in firsts])
            tile = np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64)
            yield pa.record_batch([pa.array(tile), *batch.take(pa.array(at, pa.int64())).columns], names=["tile", "item", "grp", "own"])

    return run


def short_links(items: DataFrame, least: float, ws: Workspace) -> DataFrame:
    """Links (a, b) between groups of all items (item, grp, own) whose similarity reaches ``least``: prefix filter, exact check."""
    placed = ws.keep(items.mapInArrow(_prefixes(least), "tile bigint, item bigint, grp bigint, own binary"), "short-placed")
    tiles = placed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(MEET)).alias("cut"), F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 < g2")
    blocks = ws.keep(placed.join(tiles.select("tile", "cut"), "tile").groupBy("tile", F.pmod(F.xxhash64("item"), "cut").alias("block"))
                     .agg(F.sort_array(F.collect_list(F.struct("item", "grp", "own"))).alias("left")), "short-blocks")
    pairs = blocks.join(blocks.select("tile", F.col("block").alias("block2"), F.col("left").alias("right")), "tile").where("block <= block2")
    return pairs.select("left", "right").mapInArrow(_exact(least), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id) of the documents whose group has more than one id.

    Two documents link when the Jaccard similarity of their distinct ``width``-word
    shingles (A-Z lower-cased) reaches ``similarity``; groups are connected, and
    component_id is the smallest id.  A text of fewer words is one shingle; texts
    without words are equal to one another.  Rows without an id take no part, an id
    on several rows ties their texts, an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "near")
    rows = texts_of(docs).where("doc_id is not null")
    described = ws.keep(rows.mapInArrow(_describe(width, SHORT / similarity + 1e-9), ITEM_SCHEMA), "described")
    items = ws.keep(described.groupBy("digest", "size").agg(F.min("doc_id").alias("item"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"),
                                                                F.min("short").alias("short")), "items")
    # one id may be the smallest of two sets: it stands for both, and one of the two is compared
    single = items.groupBy("item").agg(F.min(F.struct("size", "fp", "sketch", "short")).alias("s")).select("item", "s.fp", "s.sketch", "s.size", "s.short")
    tiling = Tiling(radius, segments=1, step=max(1, radius // 2), size_ratio=similarity)
    found = ws.keep(link_items(single, tiling, ws, floor=max(0.05, similarity - MARGIN)), "found")
    ends = found.select(F.col("a").alias("doc_id")).unionByName(found.select(F.col("b").alias("doc_id"))).distinct()
    sets = rows.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(width), "item bigint, own binary")
    checked = (found.join(sets.select(F.col("item").alias("a"), F.col("own").alias("x")), "a")
               .join(sets.select(F.col("item").alias("b"), F.col("own").alias("y")), "b")
               .select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a bigint, b bigint"))
    copies = described.join(items.select("digest", "size", "item"), ["digest", "size"]).where("doc_id <> item").select(
        F.col("doc_id").alias("a"), F.col("item").alias("b"))
    sure = ws.keep(connected_components(checked.unionByName(copies), ws), "sure")
    grouped = ws.keep(single.join(sure.withColumnRenamed("node", "item"), "item", "left").withColumn("grp", F.coalesce("component", "item")).drop("component"), "grouped")
    left_over = ws.keep(open_items(grouped, tiling, ws, max(0.05, similarity - MARGIN)), "left-over")
    full = rows.join(left_over.select(F.col("item").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(
        _sets(width), "item bigint, own binary")
    entry = F.struct("item", "grp", "own")
    meet = left_over.join(full, "item").groupBy("pair").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("side") == k, entry))).alias(n) for k, n in enumerate(("left", "right"))))
    late = meet.select("left", "right").mapInArrow(_exact(similarity), "a bigint, b bigint")
    few = short_links(grouped.where("short is not null").select("item", "grp", F.col("short").alias("own")), similarity, ws)
    comp = connected_components(late.unionByName(few).unionByName(sure.select(F.col("node").alias("a"), F.col("component").alias("b"))), ws, "all")
    return comp.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
