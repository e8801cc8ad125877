import hashlib
import random

import pytest

from rillframe.llm.exact_dedup import drop_copies, exact_dedup
from rillframe.llm.patricia import PatriciaTrie


def _strings(seed, n):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) * rng.choice((1, 1, 40)) for _ in range(n)]


@pytest.mark.parametrize("limit", [1 << 40, 4000, 900])
def test_trie_owners_equal_a_dictionary(limit):
    trie, want = PatriciaTrie(limit), {}
    for i, s in enumerate(_strings(7, 3000)):
        trie.insert(s, i, i, 1)
        low, high, n = want.get(s, (i, i, 0))
        want[s] = (min(low, i), max(high, i), n + 1)
    got = [(k, (o.low, o.high, o.count)) for k, o in trie.owners()]
    assert len(got) == len(want) and dict(got) == want


def _plain(rows, keep):
    groups = {}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    pick = max if keep == "high" else min
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        k = pick(ids) if ids else None
        out.append((i, k, len(groups[low(t)]), i == k, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["low", "high"])
def test_equals_brute_force_with_nulls_ties_and_long_texts(spark, keep):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000),
            (9, "x" * 299_999 + "y"), (None, "abc"), (None, "only"), (2, "aBC"), (10, " abc")]
    df = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, digest string, n_bytes long").repartition(3)
    got = sorted(map(tuple, exact_dedup(df, keep).collect()), key=repr)
    assert got == _plain(rows, keep)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(df).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(df, keep="any")


def test_drop_copies_keeps_one_row_a_text(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (2, "A", "y"), (3, None, "z"), (4, "", "w"), (None, "b", "q"), (None, "B", "r"), (5, "c", "s"),
            (None, "c", "t"), (None, "alone", "u"), (5, "other", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(3)
    got = sorted(map(tuple, drop_copies(df, keep="high").collect()), key=repr)
    b = [r for r in got if (r[1] or "").lower() == "b"]
    assert len(b) == 1 and b[0] in rows
    assert [r for r in got if r not in b] == sorted([(2, "A", "y"), (4, "", "w"), (5, "c", "s"), (None, "alone", "u"), (5, "other", "v")], key=repr)
    assert drop_copies(df, keep="high").columns == df.columns
    assert sorted(map(tuple, drop_copies(df.repartition(7), keep="high").collect()), key=repr) == got


def test_drop_copies_carries_columns_of_any_name_and_type(spark):
    df = spark.sql("""select id % 7 as body, concat('T', cast(id % 5 as string)) as text, id as doc_id, id as payload, array(id, null) as key,
        struct(id as low, 'x' as n) as part, map('a', cast(id as decimal(9, 2))) as m, timestamp'2020-01-02 03:04:05' as t, cast(null as string) as n_bytes,
        binary('z') as raw, date'2020-02-03' as d from range(40)""").repartition(3)
    got = drop_copies(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.doc_id < 5)
    assert drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 40, 900])
def test_payloads_belong_to_the_owner(limit):
    for last in (False, True):
        trie, want = PatriciaTrie(limit, last=last), {}
        for i, s in enumerate(_strings(3, 2000)):
            key = None if i % 5 == 0 else i % 97
            trie.insert(s, key, key, 1, b"%d" % i)
            want.setdefault(s, []).append((key, b"%d" % i))
        for s, o in trie.owners():
            keys = [k for k, _ in want[s] if k is not None]
            own = (max(keys) if last else min(keys)) if keys else None
            assert o.payload == min(p for k, p in want[s] if k == own)
