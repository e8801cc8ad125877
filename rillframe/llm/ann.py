"""Nearest neighbours by additive quantisation with exact reranking.

A vector is the sum of one codeword from each of several full-dimensional codebooks.
The codebooks are fitted on a bounded sample: stage by stage on residuals, then refined
by re-encoding with a beam and solving for all codewords together.  Every vector is
encoded by beam search and stored as codes, the norm of its reconstruction and the norm
of what the reconstruction misses.  A query's table of inner products with all codewords
scores a block of codes by look-ups; the missed norm turns a score into a lower and an
upper bound of the true distance, and every candidate whose lower bound is within the
k-th smallest upper bound is reranked on its original vector.  So the candidates are
never capped, and the nearest found are the true ones.

Vectors and queries meet in blocks; each task keeps the best k of its queries, and the
lists of the tasks are merged by a ranking per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, row_binaries, small_batches

#: Codebooks, codewords of each, beam width, and the most vectors a fit reads.
BOOKS, WORDS, BEAM, SAMPLE = 8, 256, 4, 8192
#: Vectors and queries of a block.
VECTORS, QUERIES = 2048, 256
#: Groups of vector blocks that queries are dealt to, and query blocks whose lists a task holds before it sends them on.
GROUPS, LISTS = 64, 32


@dataclass
class Codebooks:
    """``words`` is (books, codewords, dimensions)."""

    words: np.ndarray

    def __post_init__(self) -> None:
        self.flat = self.words.reshape(-1, self.words.shape[-1])
        self.norms = (self.words**2).sum(-1)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books): the best of ``beam`` partial sums survive each stage."""
        out = np.empty((len(x), len(self.words)), np.uint8)
        for at in range(0, len(x), 512):
            out[at:at + 512] = self._encode(x[at:at + 512], beam)
        return out

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, (books, words, dim) = len(x), self.words.shape
        left = x[:, None, :].astype(float)  # residuals of the surviving sums
        error = (left**2).sum(-1)
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for m in range(books):
            now = error[:, :, None] - 2 * (left @ self.words[m].T) + self.norms[m]
            flat = now.reshape(n, -1)
            keep = min(beam if m < books - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            at, word = np.divmod(best, words)
            left = left[rows, at] - self.words[m][word]
            error = flat[rows, best]
            codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], 2)
        return codes[:, 0]

    def of(self, dim: int) -> Codebooks:
        """These, or for another dimension empty ones: all of a vector is then missed and all are reranked."""
        return self if dim == self.words.shape[-1] else Codebooks(np.zeros((*self.words.shape[:2], dim)))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
        if (count == 0).any():
            centre[count == 0] = x[rng.choice(len(x), int((count == 0).sum()))]
    return centre


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 3, seed: int = 7) -> Codebooks:
    """Residual k-means, then rounds of beam encoding and a ridge solution for all codewords at once."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return Codebooks(np.zeros((books, words, x.shape[1])))
    left, out = x.astype(float), []
    for _ in range(books):
        centre = _kmeans(left, words, rng)
        own = ((centre**2).sum(1) - 2 * left @ centre.T).argmin(1)
        left = left - centre[own]
        out.append(centre)
    best = Codebooks(np.stack(out))
    codes = best.encode(x)
    error = ((x - best.decode(codes)) ** 2).sum()
    for _ in range(rounds):
        gram, side = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        place = codes.astype(np.int64) + words * np.arange(books)
        for a in range(books):
            np.add.at(side, place[:, a], x)
            for b in range(books):
                np.add.at(gram, (place[:, a], place[:, b]), 1.0)
        gram[np.diag_indices_from(gram)] += 0.05
        # the ridge pulls towards the present codewords, so unused ones stay
        solved = np.linalg.solve(gram, side + 0.05 * best.flat)
        then = Codebooks(solved.reshape(best.words.shape))
        codes = then.encode(x)
        now = ((x - then.decode(codes)) ** 2).sum()
        if now >= error:
            break
        best, error = then, now
    return best


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of finite numbers, not all zero, with an id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


BLOCKS = "ids binary, vectors binary, codes binary, norms binary, missed binary, dim int"


def _blocks(books: Codebooks | None, size: int):
    """Rows to blocks; with codebooks every vector is encoded."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        def block(ids: np.ndarray, x: np.ndarray):
            row = [ids.tobytes(), x.tobytes()]
            if books is not None:
                own = books.of(x.shape[1])
                codes = own.encode(x)
                back = own.decode(codes)
                row += [codes.tobytes(), (back**2).sum(1).tobytes(), np.sqrt(((x - back) ** 2).sum(1)).tobytes()]
            else:
                row += [None] * 3
            return pa.record_batch([*(pa.array([r], pa.binary()) for r in row), pa.array([x.shape[1]], pa.int32())], schema=schema)

        schema = pa.schema([*((n, pa.binary()) for n in ("ids", "vectors", "codes", "norms", "missed")), ("dim", pa.int32())])
        held: dict[int, tuple[list, list]] = {}  # by dimension: vectors of another length are other spaces
        for batch in batches:
            lists = batch.column(1)
            lens = np.diff(np.asarray(lists.offsets))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lens)
            for dim in np.unique(lens):
                rows = np.nonzero(lens == dim)[0]
                x = np.stack([flat[ends[r] - dim:ends[r]] for r in rows])
                a, b = held.setdefault(int(dim), ([], []))
                a.append(ids[rows])
                b.append(x)
                if sum(map(len, a)) >= size:
                    ids_all, x_all = np.concatenate(a), np.concatenate(b)
                    for at in range(0, len(ids_all) - len(ids_all) % size, size):
                        yield block(ids_all[at:at + size], x_all[at:at + size])
                    rest = len(ids_all) - len(ids_all) % size
                    held[int(dim)] = ([ids_all[rest:]], [x_all[rest:]])
        for a, b in held.values():
            if sum(map(len, a)):
                yield block(np.concatenate(a), np.concatenate(b))

    return run


def _nearest(order_ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by distance, ties by id."""
    if len(dist) > 4 * k:
        edge = np.partition(dist, k - 1)[k - 1]
        some = np.nonzero(dist <= edge)[0]
        return some[np.lexsort((order_ids[some], dist[some]))[:k]]
    return np.lexsort((order_ids, dist))[:k]


@dataclass
class Lists:
    """The nearest found so far of a block of queries."""

    qids: np.ndarray
    ids: list[np.ndarray]
    dist: list[np.ndarray]

    def batch(self):
        import pyarrow as pa

        return pa.record_batch([pa.array(np.repeat(self.qids, [len(x) for x in self.ids])), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.dist))],
                               names=["query_id", "vec_id", "score"])


def _take(lists: Lists, qx: np.ndarray, ids, x, codes, norms, missed, books: Codebooks, k: int) -> int:
    """A block of vectors for a block of queries; how many candidates were measured exactly."""
    place = codes.astype(np.int64) + WORDS * np.arange(len(books.words))
    tables = qx @ books.flat.T  # inner products of every query with every codeword
    measured = 0
    for i, (qid, q) in enumerate(zip(lists.qids, qx)):
        inner = tables[i][place].sum(1)
        rough = np.sqrt(np.maximum(0.0, (q**2).sum() - 2 * inner + norms))
        slack = missed + 1e-9 * (1 + rough)  # the sums above are rounded
        upper = np.where(ids == qid, np.inf, rough + slack)
        limit = lists.dist[i][-1] if len(lists.dist[i]) == k else np.inf
        if len(upper) >= k:
            limit = min(limit, np.partition(upper, k - 1)[k - 1])
        some = np.nonzero((rough - slack <= limit) & (ids != qid))[0]
        measured += len(some)
        # summed in order of the dimensions: any engine's loop gives the same double
        exact = np.sqrt(np.cumsum((x[some] - q) ** 2, axis=1)[:, -1])
        both_ids, both = np.concatenate([lists.ids[i], ids[some]]), np.concatenate([lists.dist[i], exact])
        pick = _nearest(both_ids, both, k)
        lists.ids[i], lists.dist[i] = both_ids[pick], both[pick]
    return measured


def _search(books: Codebooks, k: int):
    """Rows of a query block and a vector block -> the k nearest of each query among blocks of the task.

    The lists of LISTS query blocks are held, so a block's bound serves the next; beyond
    that the oldest are sent on and met again in the ranking.
    """

    def run(batches) -> Iterator:
        held: dict[int, Lists] = {}
        names = ("q", "ids", "vectors", "codes", "norms", "missed", "qids", "qvectors", "dim")
        for batch in batches:
            raw = {n: row_binaries(batch.column(i)) for i, n in enumerate(names) if n not in ("q", "dim")}
            for r, (q, dim) in enumerate(zip(batch.column(0).to_pylist(), batch.column(8).to_pylist())):
                ids, norms, missed = (np.frombuffer(raw[n][r], t) for n, t in (("ids", np.int64), ("norms", float), ("missed", float)))
                x, codes = np.frombuffer(raw["vectors"][r], float).reshape(-1, dim), np.frombuffer(raw["codes"][r], np.uint8).reshape(len(ids), -1)
                qids, qx = np.frombuffer(raw["qids"][r], np.int64).copy(), np.frombuffer(raw["qvectors"][r], float).reshape(-1, dim)
                if q not in held:
                    if len(held) >= LISTS:
                        yield held.pop(next(iter(held))).batch()
                    held[q] = Lists(qids, [np.empty(0, np.int64)] * len(qids), [np.empty(0)] * len(qids))
                _take(held[q], qx, ids, x, codes, norms, missed, books.of(dim), k)
        for lists in held.values():
            yield lists.batch()

    return run


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest by Euclidean distance, ties to the smaller id.

    ``queries`` has the columns of ``vectors``; None takes the rows whose id is divisible
    by ``every``.  A query's own id is no candidate of its own.  Vectors that are null,
    zero, or hold null or non-finite numbers take no part, nor do rows without an id;
    vectors are compared with those of the same length only; fewer candidates than
    ``k`` all come back.  Rows repeated with one id are candidates each; a repeated query
    id is answered once, with the nearest to any of its vectors.  Codebooks are fitted on at most
    ``sample`` vectors of the commonest length, chosen by a hash of the id.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    small_batches(spark)
    clean = _clean(vectors, id_col, vector_col)
    asked = clean.where(F.col("vec_id") % every == 0) if queries is None else _clean(queries, id_col, vector_col)
    dims = [r[0] for r in clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = clean.where(F.size("v") == dims[0]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # ``sample`` rows
    books = fit_codebooks(rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims[0]))
    index = ws.keep(clean.mapInArrow(_blocks(books, VECTORS), BLOCKS), "index")
    ask = ws.keep(asked.mapInArrow(_blocks(None, QUERIES), BLOCKS).select(
        F.monotonically_increasing_id().alias("q"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.col("dim").alias("qdim")), "queries")
    # the query set against all rows, block by block: every query block goes once to each group of vector blocks
    dealt = index.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(GROUPS)))
    asking = ask.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GROUPS - 1).cast("bigint"))).alias("part"))
    pairs = dealt.join(asking, (dealt["part"] == asking["part"]) & (dealt["dim"] == asking["qdim"])).select(
        "q", "ids", "vectors", "codes", "norms", "missed", "qids", "qvectors", "dim")
    merged = pairs.mapInArrow(_search(books, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
