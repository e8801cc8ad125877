import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rillframe.llm import mixing
from rillframe.llm.near_dup import near_duplicates
from rillframe.llm.simhash import shingle_hashes, words_of
from rillframe.llm.toxicity import fit, held_out


def shingles(text):
    return set(shingle_hashes(words_of((text or "").encode()), 5).tolist())


def groups(rows, least=0.8):
    """doc_id -> smallest id of its group, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def corpus(n, seed, copies=0.5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice((1, 3, 5, 6, 60, 200, 500)))]
        if rows and rng.random() < copies:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = corpus(350, 5) + [(800, ""), (801, " \n"), (802, None), (803, "É é"), (804, "w1 W1")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(None, "w1", "k")], "doc_id long, text string, item string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    want = groups(rows)
    assert {d: got.get(d, d) for d in want} == want
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_behind_pairs_that_fail_are_found(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(300), 4):
            words[at] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = groups(rows)
    assert {d: got.get(d, d) for d in want} == want and len(set(want.values())) < 30


def test_repeated_passages_and_short_texts_link(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        shared, passage = ([f"{c}{k}w{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("s", 212), ("p", 12)))
        rows += [(len(rows), " ".join(shared + passage)), (len(rows) + 1, " ".join(shared + passage * 40))]
    for k in range(400):  # eight words have four shingles, nine have five
        words = [f"q{k}w{i}" for i in range(9)]
        rows += [(len(rows), " ".join(words[:8])), (len(rows) + 1, " ".join(words))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # each text has one partner: its words are its own
    assert got == {d: d - d % 2 for d, _ in rows}
    sets = [shingles(t) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = corpus(200, 9)
    rows = [(i, t if rng.random() < 0.8 else f"{t} idiot moron {i}") for i, t in rows]
    rows += [(300 + i, rng.choice(rows)[1].upper()) for i in range(40)] + [(900, None), (901, ""), (902, "x " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows] + [(7, rows[7][1], "en", "s1", len(rows[7][1]))]
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("idiot" in (t or "")), 1) for i, t in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    lab = spark.createDataFrame([(i, y) for i, y, _ in labels], "doc_id long, toxic int")
    model = fit(spark.createDataFrame(docs, schema), lab.where(~held_out(lab.doc_id)))
    left = [(i, t) for i, t, *_ in docs if model.score(t) < 0.5]
    assert 0 < len(left) < len(docs)
    owner = {}
    for i, t in left:
        key = (t or "").encode().lower()
        owner[key] = max(owner.get(key, i), i)
    left = sorted({i: t for i, t in left if owner[(t or "").encode().lower()] == i}.items())
    left = [(i, t) for i, t in left if groups(left)[i] == i]
    assert sorted(got) == [i for i, _ in left]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in left:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
    assert np.unique([r.ids_sha256 for r in got.values()]).size > 10
    # the place in the mix stands on every row, whatever the order in which files are read
    whole = {i: (s, n) for i, _, _, s, n in docs}
    placed = {r.doc_id: (r.slot, r.place) for r in mixing.plan(spark.createDataFrame([(i, whole[i][0]) for i, _ in left], "doc_id long, source string")).collect()}
    assert {i: (r.slot, r.place) for i, r in got.items()} == placed
    assert all(got[i].source == whole[i][0] for i in got)


def test_stages_with_null_ids_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string, block int, digest binary"
    words = [f"w{i} v{i} u{i} t{i} s{i} r{i} q{i}" for i in range(40)]
    rows = [(i, w) for i, w in enumerate(words)] + [(None, words[3].upper()), (None, "only here without an id"), (None, "Only here without an id"), (7, words[7]), (50, None), (51, "")]
    docs = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "x", k, b"d") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(docs, schema).limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    # one row a text: ids before none, of empty texts the largest id
    assert sorted((r.doc_id for r in out), key=repr) == sorted([*range(40), None, 51], key=repr)
    assert len({(r.slot, r.place) for r in out}) == len(out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_the_corpus(spark):
    """All links of the corpus by an exact join on shared shingles: none may be lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = {}
    for d, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(d)
    both = {}
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    lost = [p for p in links if got.get(p[0], p[0]) != got.get(p[1], p[1])]
    assert len(links) > 50 and not lost
