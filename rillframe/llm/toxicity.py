"""Toxicity classifier with a counterfactual penalty on identity terms.

Features are presence of words and of their first letters.  Statistics choose the
features, a logistic model is fitted on a bounded sample of labelled documents, and
for every labelled document that names a group a counterfactual is made by swapping
the identity terms; the squared change of the score is part of the loss, so naming a
group barely moves a score.  Scoring is one pass over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, small_batches, texts_of

#: Labelled documents that a fit reads at most, chosen by a hash of doc_id.
MAX_ROWS = 12_000
#: Features of the model at most, and documents that must hold one.
MAX_FEATURES, MIN_DOCS = 3_000, 4
#: How far a feature's toxic documents must lie from chance: (seen - expected)^2 / expected.
MIN_CHI = 25.0
PREFIXES = (4, 5, 6)
MARKS = " .,!?;:|\"'()[]{}<>#*&%$-_/\\+=~`^«»„“”’…¿¡"

#: Identity terms by category; a counterfactual swaps a term for the others of its row.
IDENTITY = {
    "gender": "woman man women men girl boy female male transgender nonbinary",
    "religion": "christian muslim jewish hindu buddhist sikh catholic protestant atheist",
    "origin": "african asian european american mexican chinese indian arab immigrant refugee",
    "colour": "black white brown",
    "orientation": "gay lesbian straight bisexual queer heterosexual",
    "age": "young old teenage elderly",
    "ability": "deaf blind disabled autistic",
    "de": "frau mann frauen männer christlich muslimisch jüdisch schwarz weiß schwul lesbisch behindert ausländer",
    "fr": "femme homme femmes hommes chrétien musulman juif noir blanc homosexuel lesbienne handicapé étranger",
    "es": "mujer hombre mujeres hombres cristiano musulmán judío negro blanco homosexual lesbiana discapacitado extranjero",
}


def swaps() -> dict[str, list[str]]:
    """Term -> the terms it may be swapped for."""
    return {t: [o for o in row.split() if o != t] for row in IDENTITY.values() for t in row.split()}


def features(text: str | None) -> set[str]:
    """Words without the marks around them, and ^ with the first letters of longer words."""
    words = {w.strip(MARKS) for w in set((text or "").lower().split())}
    words.discard("")
    found = set(words)
    for n in PREFIXES:
        found.update(["^" + w[:n] for w in words if len(w) > n])
    return found


def counterfactual(found: set[str], table: dict[str, list[str]], turn: int) -> set[str] | None:
    """The features with every identity term swapped, None if there is none; ``turn`` picks the swap."""
    named = [t for t in table if t in found]
    if not named:
        return None
    words = {f for f in found if f[0] != "^"} - set(named)
    words |= {table[t][turn % len(table[t])] for t in named}
    out = set(words)
    for n in PREFIXES:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


def turns(found: set[str], table: dict[str, list[str]]) -> int:
    """Turns after which every term named has been swapped for each other term of its row."""
    return max((len(table[t]) for t in table if t in found), default=0)


@dataclass
class Model:
    """Weights by feature; the score is the logistic of their sum plus the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def __post_init__(self) -> None:
        self._known = set(self.weights)

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self._known & features(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def fit_weights(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int,
                penalty: float = 4.0, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch Adam on log loss, weighted half-way to balanced classes, + penalty * mean squared score change of the pairs."""
    x, y = Rows(rows, width), labels.astype(float)
    share = y.mean()
    each = np.sqrt(np.where(y > 0, 0.5 / share, 0.5 / (1 - share))) / len(y)
    a, b = Rows([p for p, _ in pairs], width), Rows([q for _, q in pairs], width)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        g = (logistic(x.dot(w[:-1]) + w[-1]) - y) * each
        grad = np.append(x.back(g) + ridge * w[:-1], g.sum())
        if pairs:
            sa, sb = logistic(a.dot(w[:-1]) + w[-1]), logistic(b.dot(w[:-1]) + w[-1])
            gap = 2 * penalty * (sa - sb) / len(pairs)
            ga, gb = gap * sa * (1 - sa), gap * sb * (1 - sb)
            grad += np.append(a.back(ga) - b.back(gb), ga.sum() - gb.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def _tally(batches) -> Iterator:
    """Documents that hold each feature, by label: one row a task and feature."""
    import pyarrow as pa

    counts = (Counter(), Counter())
    n = [0, 0]
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y].update(features(text))
            n[y] += 1
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.record_batch([pa.array(["", *names]), *(pa.array([n[y], *(counts[y][f] for f in names)], pa.int64()) for y in (0, 1))],
                          names=["feature", "n0", "n1"])


def _matrix(index: dict[str, int]):
    table = swaps()

    def run(batches) -> Iterator:
        import pyarrow as pa

        pick = lambda found: sorted(index[f] for f in index.keys() & found)
        for batch in batches:
            rows, others = [], []
            for text in batch.column(0).to_pylist():
                found = features(text)
                rows.append(pick(found))
                others.append([pick(c) for turn in range(turns(found, table)) if (c := counterfactual(found, table, turn)) is not None])
            yield pa.record_batch([batch.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.int32())))],
                                  names=["y", "x", "swapped"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = 4.0) -> Model:
    """Fit on at most ``max_rows`` labelled documents (doc_id, text) x (doc_id, toxic).

    Repeated labels of a document count as toxic if one says so; null labels and ids
    are left out.  Of rows repeated with one id the first text in order counts, so that
    no more than ``max_rows`` texts are ever fetched.  Without documents of both labels
    the model is the smoothed prior.
    """
    sample = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # max_rows rows of 12 bytes; the sampled texts are read again and again, the corpus once
    joined = texts_of(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "y")).alias("r"))
    rows = Workspace(docs.sparkSession, "toxicity").keep(joined.select("r.text", "r.y"), "sample")
    stats = rows.mapInArrow(_tally, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    terms = list(swaps())
    total = stats.where("feature = ''").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    if not n0 or not n1:
        return Model({}, math.log((n1 + 0.5) / (n0 + 10.0)))
    seen = F.col("n0") + F.col("n1")
    hoped = seen * F.lit(n1 / (n0 + n1))
    chosen = stats.where((F.col("feature") != "") & (seen >= MIN_DOCS)).select(
        "feature", (F.pow(F.col("n1") - hoped, 2) / hoped).alias("chi")).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES)
    names = list(dict.fromkeys([r["feature"] for r in chosen.collect()] + terms))
    index = {f: i for i, f in enumerate(names)}
    data = rows.mapInArrow(_matrix(index), "y int, x array<int>, swapped array<array<int>>").collect()
    data.sort(key=lambda r: (r["y"], r["x"]))  # the fit doesn't depend on the order of tasks
    pairs = [(r["x"], c) for r in data for c in r["swapped"]]
    w, bias = fit_weights([r["x"] for r in data], np.array([r["y"] for r in data]), pairs, len(names), penalty)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, however long; a null text scores as an empty one.

    Rows without an id and repeated rows are scored each; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())],
                                  names=["doc_id", "score"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    A decision is a row's own: ids play no part, repeated rows go or stay alike, a null text
    scores as an empty one, and a column may have any name.  An empty table gives an
    empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5): fitted on the labels that aren't held out.

    Every row comes back, repeated rows too; an empty table gives no rows.
    """
    model = fit(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), max_rows)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
