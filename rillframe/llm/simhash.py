"""SimHash fingerprints and tiled exact comparison.

Documents with one fingerprint are folded into one item first.  Items fall into
tiles by their population counts (whole fingerprint, or of equal segments of it)
and, where asked, by a size bucket; tiles are cut into blocks of bounded size.
A pair of tiles is compared only if their population counts can lie within the
radius, because the sum of the segments' count differences never exceeds the
Hamming distance.  Each pair of blocks is one row: numpy exclusive-or, bit counts,
and a union-find that sends on a spanning forest instead of all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, row_binaries, texts_of
from rillframe.llm.components import connected_components

XXH_SEED = 42
#: Items of a block: a pair of blocks needs BLOCK * BLOCK * 9 bytes at once in row chunks of CHUNK.
BLOCK, CHUNK = 2048, 256

FP_SCHEMA = "doc_id bigint, fp bigint"


def words_of(text: bytes | memoryview) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return bytes(text).lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included.

    Fewer words give one hash of the whole sequence; no word gives none.
    """
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, XXH_SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    return np.array([xxh64_intdigest(joined[a:b], XXH_SEED) for a, b in zip(starts, ends[width - 1:])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int) -> Callable:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(shingle_hashes(words_of(v), width)) for v in row_binaries(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of (doc_id, text)."""
    return docs.mapInArrow(_fingerprints(width), FP_SCHEMA)


@dataclass(frozen=True)
class Tiling:
    """How items fall into tiles; ``segments`` * ``64 // segments`` = 64."""

    radius: int
    segments: int = 4
    step: int = 1
    size_ratio: float = 0.0  # 0: sizes don't matter; else smaller/larger must reach it

    def tiles(self, fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(fps.view(self._kind()).reshape(len(fps), self.segments)).astype(np.int64) // self.step
        key = np.zeros(len(fps), np.int64)
        for c in counts.T:
            key = key * 128 + c
        if self.size_ratio:
            key = key * 1024 + np.floor(np.log(np.maximum(sizes, 1)) / -math.log(self.size_ratio) + 1e-9).astype(np.int64)
        return key

    def _kind(self):
        return {1: np.uint64, 2: np.uint32, 4: np.uint16, 8: np.uint8}[self.segments]

    def neighbours(self) -> list[int]:
        """Key offsets of the tiles that may hold partners, the tile itself included."""
        reach = (self.radius + self.step - 1) // self.step
        least = lambda d: max(0, (abs(d) - 1) * self.step + 1) if d else 0
        out = []
        for ds in itertools.product(range(-reach, reach + 1), repeat=self.segments):
            if sum(map(least, ds)) <= self.radius:
                key = 0
                for d in ds:
                    key = key * 128 + d
                out += [key * 1024 + s for s in (-1, 0, 1)] if self.size_ratio else [key]
        return out


class Forest:
    """Union-find over local indices."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Bins of the one-permutation MinHash sketch that a verifying comparison carries, one byte each.
BINS = 128


def sketch(distinct: np.ndarray) -> bytes:
    """One byte a bin: a hash of the bin's smallest value, 1 to 255; 0 marks an empty bin."""
    out = np.zeros(BINS, np.uint8)
    if len(distinct):
        mixed = np.sort(distinct * np.uint64(0x9E3779B97F4A7C15) ^ (distinct >> np.uint64(29)))
        bins = (mixed >> np.uint64(57)).astype(np.int64)
        first = np.nonzero(np.diff(bins, prepend=-1))[0]
        out[bins[first]] = (mixed[first] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _pairs(fa, fb, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(fa), CHUNK):
        near = np.bitwise_count(fa[at:at + CHUNK, None] ^ fb[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


def _estimates(sa, sb, i, j) -> np.ndarray:
    """Estimated similarity of the sketches of each pair."""
    score = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y = sa[i[at:at + (1 << 16)]], sb[j[at:at + (1 << 16)]]
        used = (x | y) > 0
        score[at:at + (1 << 16)] = ((x == y) & used).sum(1) / np.maximum(1, used.sum(1))
    return score


def _open(radius: int, floor: float) -> Callable:
    """Rows of two blocks whose sketches end with the group -> the items of candidates in two groups."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            raw = {n: row_binaries(cols[n]) for n in ("ids", "fps", "sketches", "ids2", "fps2", "sketches2")}
            for r, (same, pair) in enumerate(zip(cols["same"].to_pylist(), cols["pair"].to_pylist())):
                ia, ib = (np.frombuffer(raw[n][r], np.int64) for n in ("ids", "ids2"))
                fa, fb = (np.frombuffer(raw[n][r], np.uint64) for n in ("fps", "fps2"))
                wa, wb = (np.frombuffer(raw[n][r], np.uint8).reshape(-1, BINS + 8) for n in ("sketches", "sketches2"))
                (sa, ga), (sb, gb) = ((w[:, :BINS], np.ascontiguousarray(w[:, BINS:]).view(">i8").ravel().astype(np.int64)) for w in (wa, wb))
                left, right = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
                for i, j in _pairs(fa, fb, radius, same):
                    apart = ga[i] != gb[j]
                    i, j = i[apart], j[apart]
                    good = _estimates(sa, sb, i, j) >= floor
                    left[i[good]] = right[j[good]] = True
                n, m = int(left.sum()), int(right.sum())
                yield pa.record_batch([
                    pa.array([pair] * (n + m), pa.int64()), pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array(np.append(ia[left], ib[right])), pa.array(np.append(ga[left], gb[right]))], names=["pair", "side", "item", "grp"])

    return run


def _compare(radius: int, floor: float) -> Callable:
    """Rows of two blocks -> (a, b) item pairs of a spanning forest, strongest pairs first."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            raw = {n: row_binaries(cols[n]) for n in ("ids", "fps", "sketches", "ids2", "fps2", "sketches2")}
            out_a, out_b = [], []
            for r, same in enumerate(cols["same"].to_pylist()):
                ia, ib = (np.frombuffer(raw[n][r], np.int64) for n in ("ids", "ids2"))
                fa, fb = (np.frombuffer(raw[n][r], np.uint64) for n in ("fps", "fps2"))
                found: list = []
                forest = Forest(len(ia) + (0 if same else len(ib)))
                shift = 0 if same else len(ia)
                if floor:
                    sa, sb = (np.frombuffer(raw[n][r], np.uint8).reshape(-1, BINS) for n in ("sketches", "sketches2"))
                for i, j in _pairs(fa, fb, radius, same):
                    if floor:
                        score = _estimates(sa, sb, i, j)
                        good = np.nonzero(score >= floor)[0]
                        good = good[np.argsort(-score[good], kind="stable")]
                        found.append((score[good], i[good], j[good]))
                    else:
                        _grow(forest, i, j, shift, ia, ib, out_a, out_b)
                if floor and found:
                    score, i, j = (np.concatenate(c) for c in zip(*found))
                    best = np.argsort(-score, kind="stable")
                    _grow(forest, i[best], j[best], shift, ia, ib, out_a, out_b)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _grow(forest: Forest, i, j, shift: int, ia, ib, out_a: list, out_b: list) -> None:
    for x, y in zip(i.tolist(), j.tolist()):
        if forest.join(x, y + shift):
            out_a.append(int(ia[x]))
            out_b.append(int(ib[y]))


TILE_SCHEMA = "item bigint, fp bigint, sketch binary, tile bigint"
BLOCK_SCHEMA = "tile bigint, block bigint, ids binary, fps binary, sketches binary"
OPEN_SCHEMA = "pair bigint, side int, item bigint, grp bigint"


def _place(tiling: Tiling) -> Callable:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            tiles = tiling.tiles(np.ascontiguousarray(fps).view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(tiles)], names=["item", "fp", "sketch", "tile"])

    return run


def block_pairs(items: DataFrame, tiling: Tiling, ws: Workspace, label: str = "") -> DataFrame:
    """Pairs of blocks of items (item, fp, sketch, size) that may hold partners, each pair once.

    The keys of the blocks are paired first: a row a block, joined with the neighbour
    tiles that exist.  The payloads are fetched for these pairs alone, by (tile, block), so
    the pairs of the fullest tile are spread over its blocks.
    """
    placed = ws.keep(items.select("item", "fp", "sketch", "size").mapInArrow(_place(tiling), TILE_SCHEMA), f"{label}placed")
    # one row a tile that is used, which may be as many as the documents: Spark chooses the join by its size
    tiles = placed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("cut"))
    blocks = ws.keep(
        placed.join(tiles, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), "cut").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("item", "fp", "sketch"))).alias("rows"))
        .mapInArrow(_pack, BLOCK_SCHEMA), f"{label}blocks")
    keys = blocks.select("tile", "block")
    # a pair of tiles meets at the smaller key only
    ahead = F.array(*[F.lit(d).cast("bigint") for d in tiling.neighbours() if d >= 0])
    visits = keys.select("tile", "block", F.explode(ahead).alias("offset")).select("tile", "block", (F.col("tile") + F.col("offset")).alias("home"))
    pairs = ws.keep(visits.join(keys.select(F.col("tile").alias("home"), F.col("block").alias("block2")), "home")
                    .where((F.col("tile") != F.col("home")) | (F.col("block") <= F.col("block2"))), f"{label}pairs")
    payload = ("ids", "fps", "sketches")
    left = blocks.select("tile", "block", *payload)
    right = blocks.select(F.col("tile").alias("home"), F.col("block").alias("block2"), *[F.col(n).alias(n + "2") for n in payload])
    same = (F.col("tile") == F.col("home")) & (F.col("block") == F.col("block2"))
    return pairs.join(left, ["tile", "block"]).join(right, ["home", "block2"]).select(
        *payload, *[n + "2" for n in payload], same.alias("same"), F.xxhash64("tile", "block", "home", "block2").alias("pair"))


def link_items(items: DataFrame, tiling: Tiling, ws: Workspace, floor: float = 0.0) -> DataFrame:
    """Edges (a, b) between items (item, fp, sketch, size) whose fingerprints lie within the radius.

    Per pair of blocks a spanning forest of the links comes back, so components
    are those of all links.  With ``floor`` a pair must also reach that estimated
    similarity of the sketches, and the forest takes the strongest pairs first:
    if such pairs are still to be verified, ``open_items`` finds those left over.
    """
    return block_pairs(items, tiling, ws).drop("pair").mapInArrow(_compare(tiling.radius, floor), "a bigint, b bigint").distinct()


def open_items(items: DataFrame, tiling: Tiling, ws: Workspace, floor: float) -> DataFrame:
    """(pair, side, item, grp): the items of each pair of blocks with a candidate in another group.

    ``items`` has grp besides; a candidate lies within the radius and reaches the floor.
    """
    carried = items.withColumn("sketch", F.concat("sketch", F.unhex(F.lpad(F.hex("grp"), 16, "0"))))
    return block_pairs(carried, tiling, ws, "open-").mapInArrow(_open(tiling.radius, floor), OPEN_SCHEMA)


def _pack(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for r in range(batch.num_rows):
            rows = batch.column(2)[r].values
            ids, fps = (rows.field(n).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for n in ("item", "fp"))
            sketches = b"".join(map(bytes, row_binaries(rows.field("sketch")))) if rows.field("sketch").null_count == 0 else b""
            yield pa.record_batch([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), *(pa.array([x], pa.binary()) for x in (ids, fps, sketches))],
                                  names=["tile", "block", "ids", "fps", "sketches"])


def simhash_components(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable.  A null or word-free text has fingerprint zero and
    links like any other.  Rows with a null doc_id keep that null and take the
    component of their fingerprint (null if no other id is there).  Rows repeated
    with one doc_id all come back; if their texts differ, the id ties both texts.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.keep(fingerprints(texts_of(docs, id_col, text_col), width), "fps")
    items = ws.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "items")
    links = link_items(
        items.where("first is not null").select(F.col("first").alias("item"), "fp", F.lit(None).cast("binary").alias("sketch"), F.lit(0).cast("bigint").alias("size")),
        Tiling(radius, segments=4 if radius <= 4 else 1, step=1 if radius <= 4 else max(1, radius // 2)), ws)
    # an id that stands on rows of several fingerprints ties them: its other fingerprints' items join its smallest
    repeats = (fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2")).where("f1 <> f2").select("doc_id"))
    tied = (fps.join(repeats, "doc_id", "left_semi").join(items, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    comp = connected_components(links.unionByName(tied), ws)
    named = items.join(comp, items["first"] == comp["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
