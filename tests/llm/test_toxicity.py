import random
import zlib

import numpy as np
import pyarrow as pa

from rillframe.llm.toxicity import Model, _matrix, classify, counterfactual, features, fit, fit_weights, reject, score, swaps


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 40))]
        toxic = rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(("idiot", "Moron!", "vilexa", "vilexo", "vilexan")))
        if rng.random() < (0.8 if toxic else 0.1):  # the sample ties the group to the label
            words.insert(0, "muslim")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    docs += [(9000, None), (9001, ""), (9002, "x " * 100_000 + "idiot"), (None, "idiot"), (5, "word1")]
    d = spark.createDataFrame([(i, t, 7.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    la = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 0), (7000, None, 0)], "doc_id long, toxic int, held_out int")
    rows = classify(d, la).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 1 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_penalty_lowers_the_weight_of_group_mentions(spark):
    docs, labels = corpus()
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, tied = fit(d, la, penalty=0.0), fit(d, la, penalty=40.0)
    gap = lambda m: m.score("word1 word2 muslim") - m.score("word1 word2 hindu")
    assert abs(gap(tied)) < 0.3 * abs(gap(free))
    assert tied.score("word1 muslim") < 0.5 < tied.score("muslim idiot")


def test_counterfactual_swaps_only_identity_terms():
    table = swaps()
    assert counterfactual(features("a plain text"), table, 0) is None
    got = counterfactual(features("the woman sings"), table, 0)
    assert "woman" not in got and "man" in got and {"the", "sings", "^sing"} <= got


def test_every_other_term_of_a_row_is_a_target():
    table = swaps()
    for term, others in table.items():
        index = {f: i for i, f in enumerate(table)}
        batch = pa.record_batch([pa.array([f"the {term} sings"]), pa.array([0], pa.int32())], names=["text", "y"])
        (out,) = _matrix(index)([batch])
        assert {c for s in out.column(2).to_pylist()[0] for c in s} == {index[o] for o in others}


def test_one_label_only_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert classify(none, labels).count() == 0
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert [r.predicted for r in classify(d, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()] == [0, 0]
    w, b = fit_weights([[0], [1]], np.array([1, 0]), [], 2)
    assert w[0] > w[1] and Model({}, b).score(None) < 1


def test_reject_decides_by_row(spark):
    model = Model({"idiot": 9.0}, -3.0)
    rows = [(1, "a word", 1), (None, "you idiot", 2), (None, None, 3), (1, "idiot", 4), (2, "", 5), (2, "", 5), (3, "x " * 50_000 + "idiot", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    kept = reject(df, model)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)
    assert reject(df.limit(0), model).count() == 0
    assert sorted(((r.doc_id, r.score > 0.5) for r in score(df, model).collect()), key=repr) == sorted(((i, "idiot" in (t or "")) for i, t, _ in rows), key=repr)


def test_an_id_on_very_many_rows_is_fetched_once(spark):
    docs, labels = corpus()
    many = docs + [(docs[0][0], f"{docs[0][1]} again {i}") for i in range(300)]
    la = spark.createDataFrame(labels, "doc_id long, toxic int")
    once, often = (fit(spark.createDataFrame(d, "doc_id long, text string").repartition(3), la) for d in (docs, many))
    assert once.bias == often.bias and once.weights == often.weights
