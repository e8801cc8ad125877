import numpy as np

from rillframe.llm import ann
from rillframe.llm.ann import Codebooks, fit_codebooks, nearest


def plain(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in good:
        if q in asked:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, round(d, 9)) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_equals_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) + 3 * (i % 4)]) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(300)]  # ties
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] + [1.0] * 15), (2400, [float("inf")] * 16), (None, [1.0] * 16),
             (2500, [1.0, 2.0]), (2501, [1.0, 3.0]), (2600, []), (1, [5.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(df, sample=400, every=50).collect())
    assert got == plain(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 10)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    few = nearest(spark.createDataFrame([(100, [1.0, 0.0]), (3, [0.0, 2.0]), (200, [0.0, 0.5])], schema))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few.collect()) == [(100, 1, 200), (100, 2, 3), (200, 1, 100), (200, 2, 3)]


def test_codes_beat_one_book_and_beams_beat_greedy():
    x = np.random.default_rng(5).normal(size=(600, 12))
    books = fit_codebooks(x, books=4, words=16)
    error = lambda b, beam: ((x - b.decode(b.encode(x, beam))) ** 2).sum()
    one = Codebooks(books.words[:1])
    assert error(books, 8) <= error(books, 1) < error(one, 1)


def test_lists_that_are_sent_on_early_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "LISTS", 1)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "VECTORS", 16)
    monkeypatch.setattr(ann, "GROUPS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=300).tolist()) for i in range(120)]  # more dimensions than a codeword's number has bits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(df, every=10, k=5).collect())
    assert got == plain(rows, set(range(0, 120, 10)), 5)


def test_codes_spare_exact_distances():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 32)) * 3
    x = centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3
    books = fit_codebooks(x[:2000])
    codes = books.encode(x)
    back = books.decode(codes)
    lists = ann.Lists(np.arange(20), [np.empty(0, np.int64)] * 20, [np.empty(0)] * 20)
    measured = sum(ann._take(lists, x[:20], np.arange(at, at + 500), x[at:at + 500], codes[at:at + 500], (back[at:at + 500] ** 2).sum(1),
                             np.sqrt(((x - back)[at:at + 500] ** 2).sum(1)), books, 10) for at in range(0, 4000, 500))
    want = [sorted((np.sqrt(((x - q) ** 2).sum(1))).tolist())[1:11] for q in x[:20]]
    assert np.allclose([d.tolist() for d in lists.dist], want)
    assert measured < 0.25 * 20 * 4000
