import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillframe.llm import hpylm
from rillframe.llm.hpylm import END, START, Frequent, Shard, language_scores, log_stirling, sample_tables, seat_root, tokens_of


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n, seed=4):
    """Two tongues: the words before tell which word comes, and rare words are many."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t, words, at = rng.randrange(2), [], rng.randrange(40)
        for _ in range(rng.randrange(0, 60)):
            at = (at * 3 + 1 + rng.randrange(3)) % 40
            words.append(f"{'az'[t]}{at}" if rng.random() < 0.8 else f"{rng.randrange(400)}{'xyz'[t]}en")
        rows.append((i, " ".join(words)))
    return rows


def plain(rows):
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows]


def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


@pytest.mark.parametrize(("sent", "shard", "part"), [(262_144, 1 << 20, 1 << 18), (30, 900, 200), (0, 9000, 1 << 18)])
def test_counts_and_base_equal_brute_force_and_model_wins(spark, monkeypatch, sent, shard, part):
    monkeypatch.setattr(hpylm, "PART", part)
    rows = corpus(400) + [(900, None), (901, ""), (902, "\t A0 a0\x0b a0  "), (903, "never seen \x1c words é"), (904, "a1 " * 30_000), (None, "a1 a2"), (5, "a3"), (5, "a3")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, shard int, run string").repartition(3)
    got = language_scores(df, is_held(), sent, shard, burn=2, samples=2).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(plain(rows), key=repr)
    out = [r for r in got if r.held_out and (r.doc_id or 0) < 400]
    assert all(r.score < 0 for r in got) and sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


# --- the model against plain Python -----------------------------------------


def shard_of(texts, probes=()):
    """A shard of training texts and held-out probes, and the place in it of each probe's last word (or end, for those that end in one)."""
    names = sorted({w for t in texts for w in t.split()})
    count = Counter(w for t in texts for w in t.split())
    known = Frequent(np.array([hpylm._hash(n.encode()) for n in names] + [END], np.int64), np.array([count[n] for n in names] + [len(texts)]), np.zeros(len(names) + 1), 0.1)
    every = [*texts, *(t for t, _ in probes)]

    class Sent:
        value = known

    batch = pa.record_batch([pa.array(range(len(every)), pa.int64()), pa.array(every), pa.array([i >= len(texts) for i in range(len(every))])],
                            names=["doc_id", "text", "held_out"])
    out = [b for b in hpylm._deal(Sent, 1, len(texts))([batch])]
    shard = Shard([x for b in out for x, kind in zip(b.column(2).to_pylist(), b.column(1).to_pylist()) if kind == 1], known)
    sizes = [len(t.split()) + 1 for t in every]
    starts = np.cumsum([0, *sizes])
    return shard, names, [shard.of[starts[len(texts) + i] + at] for i, (_, at) in enumerate(probes)]


def asking(a, b, words):
    """Held-out texts and places of their tokens that ask for each word after a and b; < is the start."""
    lead = [x for x in (a, b) if x != "<"]
    return [(" ".join([*lead, *([] if w == "\n" else [w])]), len(lead)) for w in words]


TEXTS = ["a b a b c", "a b a b c c", "b a b", "c c c a b", "a b a", "b b a b a b", "", "c a b a b a b c"]


class Crp:
    """A restaurant seated one customer at a time: dish -> sizes of its tables."""

    def __init__(self, parent, discount):
        self.parent, self.d, self.at = parent, discount, defaultdict(list)

    def p(self, w):
        tables = sum(map(len, self.at.values()))
        customers = sum(map(sum, self.at.values()))
        up = self.parent.p(w) if isinstance(self.parent, Crp) else self.parent[w]
        return (sum(self.at[w]) - self.d * len(self.at[w]) + (1 + self.d * tables) * up) / (1 + customers)

    def add(self, w, rng):
        up = self.parent.p(w) if isinstance(self.parent, Crp) else self.parent[w]
        tables = sum(map(len, self.at.values()))
        weights = [n - self.d for n in self.at[w]] + [(1 + self.d * tables) * up]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(self.at[w]):
            self.at[w].append(1)
            if isinstance(self.parent, Crp):
                self.parent.add(w, rng)
        else:
            self.at[w][k] += 1

    def remove(self, w, rng):
        k = rng.choices(range(len(self.at[w])), self.at[w])[0]
        self.at[w][k] -= 1
        if not self.at[w][k]:
            self.at[w].pop(k)
            if isinstance(self.parent, Crp):
                self.parent.remove(w, rng)


def test_predictions_equal_seating_one_customer_at_a_time():
    names, asked = ["a", "b", "c"], [("a", "b"), ("b", "a"), ("c", "c"), ("<", "<"), ("<", "a"), ("c", "b")]
    words = [*names, "\n", "new"]
    p0 = {w: x for w, x in zip(words, (0.3, 0.25, 0.2, 0.15, 0.1))}
    shard, _, places = shard_of(TEXTS, [p for q in asked for p in asking(*q, words[:4])])
    by_hash = {hpylm._hash(w.encode()) if w != "\n" else END: p for w, p in p0.items()}
    base = np.array([by_hash[int(x)] for x in shard.words])
    got = shard.predict(base, 50, 1200, np.random.default_rng(3))[places].reshape(len(asked), 4)

    rng, low, high, customers = random.Random(1), {}, {}, []
    for t in TEXTS:
        seq = ["<", "<", *t.split(), "\n"]
        customers += [(tuple(seq[i - 2:i]), seq[i]) for i in range(2, len(seq))]
    for (a, b), w in customers:
        low.setdefault(b, Crp(p0, shard.d1))
        high.setdefault((a, b), Crp(low[b], shard.d2)).add(w, rng)
    asked = [("a", "b"), ("b", "a"), ("c", "c"), ("<", "<"), ("<", "a"), ("c", "b")]
    want = {q: np.zeros(4) for q in asked}
    rounds = 1500
    for i in range(rounds + 100):
        for c, w in customers:
            high[c].remove(w, rng)
            high[c].add(w, rng)
        if i >= 100:
            for a, b in asked:
                r = high.get((a, b), low[b])
                want[a, b] += [r.p(w) / rounds for w in words[:4]]
    for (a, b), p in zip(asked, got):
        assert np.allclose(p, want[a, b], atol=0.03), (a, b, p, want[a, b])


def test_predictions_sum_to_one_in_known_and_unknown_contexts():
    p = seat_root(np.array([3, 5]), np.array([3, 1]), 4, np.random.default_rng(0), 8)  # two numbers of customers at the root
    assert abs(3 * p[1] + p[2] + p[0] - 1) < 1e-12 and p[2] > p[1] > p[0] > 0
    asked = [("a", "b"), ("c", "c"), ("a", "nowhere"), ("nowhere", "a"), ("<", "<")]
    shard, names, places = shard_of(TEXTS, [x for q in asked for x in asking(*q, ["a", "b", "c", "\n", "never"])])
    of = {hpylm._hash(b"never"): p[0], hpylm._hash(b"nowhere"): p[0], END: p[2]}
    p0 = np.array([of.get(int(w), p[1]) for w in shard.words])
    got = shard.predict(p0, 5, 20, np.random.default_rng(1))[places].reshape(len(asked), 5)
    assert np.allclose(got.sum(1), 1, atol=1e-9) and (got > 0).all()


def test_gibbs_draws_the_exact_distribution_of_tables():
    c, base, d, s = np.array([3, 4, 2]), np.array([0.3, 0.7, 0.5]), 0.5, 1.0
    st, rng, t, u = log_stirling(d), np.random.default_rng(1), np.array([1, 1, 1]), np.array([0, 0, 1])
    seen, other = Counter(), Counter()
    for i in range(12_000):
        t = sample_tables(c, t, base, u, s, d, st, rng, groups=8)
        if i > 100:
            seen[tuple(t[:2])] += 1
            other[int(t[2])] += 1
    weight = {}
    for a in range(1, 4):
        for b in range(1, 5):
            opened = math.prod(s + d * i for i in range(a + b))
            weight[a, b] = math.exp(st[3, a] + st[4, b]) * opened * 0.3**a * 0.7**b
    z, n = sum(weight.values()), sum(seen.values())
    # both dishes may be updated in one turn now and then, each from the other's tables before it
    assert all(abs(seen[k] / n - w / z) < 0.03 for k, w in weight.items())
    two = math.exp(st[2, 2]) * s * (s + d) * 0.25, math.exp(st[2, 1]) * s * 0.5
    assert abs(other[2] / n - two[0] / sum(two)) < 0.02  # another restaurant knows nothing of the first


def test_production_turns_keep_the_tables_of_large_dishes():
    """Production turns against the exact conditional of one dish after the other, with dishes above EXACT."""
    c, base, d, s = np.array([150, 700, 40, 5]), np.array([0.2, 0.5, 0.05, 0.25]), 0.5, 1.0
    rng, st = np.random.default_rng(3), log_stirling(d)
    full = log_stirling(d, 700)
    t, plain, got = np.ones(4, np.int64), np.zeros(4), np.zeros(4)
    for i in range(1500):  # exact conditional of each dish in turn
        for m in range(4):
            k = np.arange(1, c[m] + 1)
            logit = full[c[m], 1:c[m] + 1] + np.cumsum(np.log(s + d * (t.sum() - t[m] + k - 1))) + k * np.log(base[m])
            t[m] = 1 + (logit + rng.gumbel(size=len(k))).argmax()
        plain += t * (i >= 200) / 1300
    t = np.ones(4, np.int64)
    for i in range(1500):
        t = sample_tables(c, t, base, np.zeros(4, np.int64), s, d, st, rng)
        got += t * (i >= 200) / 1300
    assert np.allclose(got, plain, rtol=0.1), (got, plain)


def test_tokens_contexts_and_packing():
    texts = ["A b", None, " a\x0b\x1cb  ", "", "b a b a c"]
    run = tokens_of(pa.array(texts))
    want = [[*(hpylm._hash(x) for x in (w or "").encode().lower().split()), END] for w in texts]
    assert run.hashes[run.place].tolist() == sum(want, [])
    known = Frequent(np.array([hpylm._hash(b"b"), END], np.int64), np.array([9, 5]), np.zeros(2), 0.1)
    words, group, hashes = hpylm.contexts(run, np.arange(5), known, 5)
    assert not group.any()
    doc, group = 2 * run.text + (run.text == 2), np.arange(len(group)) % 4
    some = np.arange(len(doc)) % 3 != 1
    t = hpylm.unpack(hpylm.pack(77, doc[some], words[:, some], group[some], hashes, known.ranks(hashes)), known)
    before = [(own[k - 1] if k else START, own[k - 2] if k > 1 else START) for own in want for k in range(len(own))]
    flat = [(i, *x) for i, x in zip([i for i, own in enumerate(want) for _ in own], zip(sum(want, []), before))]
    flat = [x for x, k in zip(flat, some) if k]
    assert t.run == 77 and t.text.tolist() == [x[0] for x in flat] and t.w.tolist() == [x[1] for x in flat] and t.held.tolist() == [x[0] == 2 for x in flat]
    assert t.a.tolist() == [x[2][1] for x in flat] and t.key.tolist() == hpylm.mixed(np.array([x[2][0] for x in flat]), group[some]).tolist()


def test_frequent_words_have_restaurants_by_class(monkeypatch):
    monkeypatch.setattr(hpylm, "PART", 10)
    monkeypatch.setattr(hpylm, "PAIR", 40)
    a, ids = np.repeat(np.arange(200), 5), np.tile(np.arange(5), 200)
    few = hpylm._group(a, ids, np.full(1000, 9), np.full(1000, 9))
    many = hpylm._group(a, ids, np.full(1000, 30), np.full(1000, 95))
    both = hpylm._group(a, ids, np.full(1000, 95), np.full(1000, 95))
    assert not few.any() and set(many) == set(range(10)) and set(both) == set(range(10))
    assert (many.reshape(200, 5) == many.reshape(200, 5)[:, :1]).all()  # a class of the word before
    assert (both.reshape(200, 5) != both.reshape(200, 5)[:, :1]).any()  # and of texts where both are very frequent


def test_runs_of_any_size_give_one_shard(monkeypatch):
    whole, *_ = shard_of(TEXTS * 20)
    monkeypatch.setattr(hpylm, "RUN_BYTES", 50)
    small, *_ = shard_of(TEXTS * 20)
    assert np.array_equal(whole.c2, small.c2) and np.array_equal(whole.words, small.words) and np.array_equal(whole.of, small.of)
    sums = [np.array([3.0, 0, 70_000]), np.array([1.0, 0, 9]), np.array([-3.5, -0.1, 2.0]), np.array([1e-9, -7.0, 0])]
    texts, back = hpylm.unpack_sums(hpylm.pack_sums(np.array([2, 5, 900]), sums))
    assert texts.tolist() == [2, 5, 900] and all(np.array_equal(a, b) for a, b in zip(sums, back))


def test_empty_table_and_no_training_texts(spark):
    schema = "doc_id long, text string"
    assert language_scores(spark.createDataFrame([], schema), F.lit(False), burn=1, samples=1).count() == 0
    (r,) = language_scores(spark.createDataFrame([(1, "a b")], schema), F.lit(True), burn=1, samples=1).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0


def test_a_shard_takes_few_bytes_a_token():
    """A task has two shards beside the JVM's heap, so building and sampling one are bounded together."""
    import tracemalloc

    rng, n = np.random.default_rng(1), 400_000
    hashes = rng.integers(-1 << 62, 1 << 62, 200_000)
    words = (rng.random((3, n)) ** 3 * len(hashes)).astype(np.int32)
    known = Frequent(hashes[:1000], np.arange(2000, 1000, -1), np.full(1000, 1e-4), 1e-6)
    blob = hpylm.pack(0, np.arange(n) // 500 * 2, words, np.zeros(n, np.int64), hashes, known.ranks(hashes))
    tracemalloc.start()
    try:
        Shard([blob], known).predict(np.full(len(hashes), 1e-6), 0, 1, rng)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 130 * n


def blob_of(rng, n, names, known, groups=1):
    """Random tokens, packed, and what they are: text, held out, hashes of the three words, group."""
    doc = np.sort(rng.integers(0, n // 20 + 1, n)) * 2
    doc += doc // 2 % 3 == 0
    words, group = (rng.random((3, n)) ** 2 * len(names)).astype(np.int32), rng.integers(0, groups, n)
    return hpylm.pack(0, doc, words, group, names, known.ranks(names)), (doc // 2, doc % 2, *names[words], group)


@pytest.mark.parametrize("most", [1 << 62, 1])
def test_levels_are_numbered_as_dictionaries_would(monkeypatch, most):
    """Rare and frequent words, groups, several blobs; also where columns don't fit into one number."""
    monkeypatch.setattr(hpylm, "MOST", most)
    rng = np.random.default_rng(2)
    names = rng.integers(-1 << 62, 1 << 62, 60)
    known = Frequent(names[10:30], np.arange(220, 200, -1), np.full(20, 1e-3), 1e-4)
    blobs, every = zip(*(blob_of(rng, n, rng.permutation(names)[:40], known, 3) for n in (700, 1, 300)))
    shard = Shard(list(blobs), known)
    tri = [tuple(map(int, x)) for own in every for x in zip(own[5], own[3], own[4], own[2])]  # group, b, w, a
    held = [bool(x) for own in every for x in own[1]]
    customers = Counter(x for x, h in zip(tri, held) if not h)
    by_number = {}
    for x, i in zip(tri, shard.of.tolist()):
        assert by_number.setdefault(i, x) == x
    assert len(by_number) == len(set(tri)) == len(shard.c2)
    assert all(customers[x] == shard.c2[i] for i, x in by_number.items())
    for level, part in ((shard.u2, lambda x: (x[0], x[1], x[3])), (shard.up, lambda x: x[:3]), (shard.u1[shard.up], lambda x: x[:2]), (shard.w1[shard.up], lambda x: x[2])):
        assert len({(part(x), int(level[i])) for i, x in by_number.items()}) == len({part(x) for x in tri}) == len(set(level.tolist()))
    assert all(shard.words[shard.w1[shard.up[i]]] == x[2] for i, x in by_number.items()) and (np.diff(shard.words) > 0).all()
    ones, values = [], rng.random(len(shard.c2))
    for (_, texts, (n, total)), own, at in zip(shard.by_text(values), every, (0, 700, 701)):
        of = shard.of[at:at + len(own[0])]
        assert texts.tolist() == sorted(set(own[0].tolist())) and n.tolist() == [int((own[0] == t).sum()) for t in texts]
        assert np.allclose(total, [values[of[own[0] == t]].sum() for t in texts])
        ones += n.tolist()
    assert sum(ones) == 1001


def test_a_shard_sorts_its_tokens_once_and_its_trigrams_once(monkeypatch):
    """Sorting is most of what building a shard costs, and both passes build every shard."""
    rng, n, sorted_ = np.random.default_rng(1), 100_000, []
    names = rng.integers(-1 << 62, 1 << 62, 20_000)
    known = Frequent(names[:1000], np.arange(2000, 1000, -1), np.full(1000, 1e-4), 1e-6)
    blob, _ = blob_of(rng, n, names, known)
    for name in ("argsort", "sort", "unique"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **k: (sorted_.append(np.size(x)), f(x, *a, **k))[1])
    shard = Shard([blob], known)
    assert len(shard.c2) > 0.9 * n and n < sum(sorted_) < 2.6 * n  # and of names


def test_narrow_draws_are_the_exact_conditional_and_never_overflow():
    for d, c, base, rest in ((0.5, 3, 0.1, 5), (0.9, 7, 0.02, 40), (0.05, 20, 0.01, 1000), (0.95, 32, 0.001, 700)):
        st, k, n = log_stirling(d), np.arange(1, c + 1), 20_000
        logit = st[c, 1:c + 1] + np.cumsum(np.log(1 + d * (rest + k - 1))) + k * np.log(base)
        p = np.exp(logit - logit.max())
        p /= p.sum()
        t = sample_tables(np.full(n, c), np.ones(n, np.int64), np.full(n, base), np.arange(n), 1.0, d, st, np.random.default_rng(5), others=np.full(n, rest))
        got = np.bincount(t, minlength=c + 1)[1:] / n
        assert abs(got - p).max() < 0.02, (d, c)
    for d in (0.05, 0.95):
        for base, want in ((1.0, 32), (1e-300, 1)):
            with np.errstate(over="raise", invalid="raise"):
                t = sample_tables(np.full(9, 32), np.ones(9, np.int64), np.full(9, base), np.arange(9), 1.0, d, log_stirling(d), np.random.default_rng(1), others=np.full(9, 1 << 24))
            assert abs(t - want).max() <= 1
