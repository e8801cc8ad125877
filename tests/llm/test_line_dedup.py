import random

import numpy as np
import pyarrow as pa
import pytest

from rillframe.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abé"))
        elif s and at < len(s):
            if kind == 1:
                s[at] = rng.choice("abé")
            else:
                del s[at]
    return "".join(s)


def test_banded_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(6000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))
        b = edited(rng, a, rng.randrange(0, 6)) if rng.random() < 0.9 else "".join(rng.choice("ab") for _ in range(rng.randrange(0, 12)))
        for most in (0, 1, 2, 3, 5):
            assert ld.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_a_probe_finds_every_line_within_tau(tau):
    rng = random.Random(tau)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(tau + 1, 40)))
        b = edited(rng, a, tau)
        if len(b) <= tau or distance(a, b) > tau:
            continue
        a, b = sorted((a, b), key=len)
        key = ld.first_key(a, b, tau)
        assert key is not None and key in ld.keys_of(a, tau)[0] and key in ld.keys_of(b, tau)[1]


def plain(rows, tau=2):
    """doc_id -> (lines, kept, links, class) by comparing all pairs of lines."""
    places = {}
    for d, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            places.setdefault(x, []).append((d is None, d, p))
    lines = [x for x in places if x.strip()]
    up, links = {x: x for x in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = ld.allowed(min(len(a), len(b)), tau)
            if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    order = lambda p: (p[0], p[1] or 0, p[2])
    owner = {}
    for x in lines:
        best = min(places[x], key=order)
        owner[find(x)] = min(owner.get(find(x), best), best, key=order)
    out = {}
    for d, t in rows:
        n, kept, k, cls = out.get(d, (0, 0, 0, None))
        for p, x in enumerate((t or "").split("\n")):
            n += 1
            if not x.strip():
                kept += 1
                continue
            o = owner[find(x)]
            kept += o[1:] == (d, p)
            k += links[x]
            cls = o[1] if cls is None else min(cls, o[1] if o[1] is not None else cls)
        out[d] = (n, kept, k, cls)
    return sorted(((d, n, kept, k, d if cls is None else cls) for d, (n, kept, k, cls) in out.items()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((3, 9, 12, 25, 60, 130)))) for _ in range(60)]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(edited(rng, rng.choice(pool), rng.choice((0, 0, 1, 2, 3))) if rng.random() < 0.8 else rng.choice(["", " ", "ab"]) for _ in range(rng.randrange(1, 7)))))
    return rows


@pytest.mark.parametrize(("block", "local"), [(512, 256), (4, 2)])
def test_equals_all_pairs(spark, monkeypatch, block, local):
    monkeypatch.setattr(ld, "BLOCK", block)
    monkeypatch.setattr(ld, "LOCAL", local)
    rows = corpus(block, 120) + [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 900 + "\n" + "x" * 901), (7, "abcdefgh abcdefgh"), (7, "abcdefgh abcdefgh")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, line string").repartition(4)
    got = sorted(map(tuple, ld.line_dedup(df).collect()), key=repr)
    want = plain(rows)
    assert [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]


def test_texts_without_repeated_lines_and_empty_table(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(2, "a line that is here twice\nown line of two"), (1, "a line that is here twicf\n\nown line of one"), (3, None)], schema)
    got = {r.doc_id: r.text for r in ld.drop_lines(df).collect()}
    assert got[1] == "a line that is here twicf\n\nown line of one" and "twice" not in got[2] and got[3] == ""
    assert ld.line_dedup(spark.createDataFrame([], schema)).count() == 0


def test_drop_lines_with_null_ids_repeats_clashes_and_long_texts(spark):
    line, other = "a line that is long enough", "another line of some length"
    rows = [(None, f"{line}\nonly here and nowhere else"), (None, None), (None, f"{line}\nmore"), (4, f"{line}\n{other}"), (4, f"{line}\n{other}"), (9, other),
            (10, ""), (11, "\n".join([line] * 20_000 + ["the end of it"]))]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, row int, gone int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ld.drop_lines(df).collect()), key=repr)
    # ids come before none: document 4 owns both lines, in both of its rows
    want = [(None, "only here and nowhere else"), (None, ""), (None, "more"), (4, f"{line}\n{other}"), (4, f"{line}\n{other}"), (9, ""), (10, ""), (11, "the end of it")]
    assert got == sorted(want, key=repr)
    assert ld.drop_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_buckets_are_streamed_one_at_a_time(monkeypatch, held):
    rng, rows, want = np.random.default_rng(5), [], set()
    seen = {}
    for bucket in range(6):
        for _ in range(5):
            k, v = rng.integers(0, 30, 40) * 10 + bucket, rng.integers(0, 12, 40)
            rows.append((bucket, k.tobytes(), v.tobytes()))
            for a, b in zip(k.tolist(), v.tolist()):
                seen.setdefault(a, set()).add(b)
    for k, vs in seen.items():
        if len({v >> 1 for v in vs}) > 1 and any(v & 1 for v in vs) and any(not v & 1 for v in vs):
            want |= {(k, v >> 1, bool(v & 1)) for v in vs}
    monkeypatch.setattr(ld, "HELD", held)
    batch = pa.record_batch([pa.array([r[i] for r in rows]) for i in range(3)], names=["bucket", "keys", "lines"])
    got = [tuple(r.values()) for b in ld._meetings([batch.slice(0, 11), batch.slice(11)]) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_very_long_lines():
    a = "xy" * 60_000
    assert ld.within(a, a[:50_000] + "z" + a[50_001:], 2) and not ld.within(a, "zzz" + a[3:], 2)
    assert ld.first_key(a, a[:-1] + "zz") in ld.keys_of(a)[0]
