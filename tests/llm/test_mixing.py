import random
from fractions import Fraction

from pyspark.sql import functions as F

from rillframe.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(3)


def edf(weights, slots):
    """Plain simulation over all sources: slot -> source."""
    n, k, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = [(-(-(k[s] + 1) * n // weights[s]), s) for s in sorted(weights) if k[s] * n // weights[s] <= t]
        s = min(ready)[1]
        k[s] += 1
        out.append(s)
    return out


def deviations(slots, targets, until):
    """Largest distance of a source from its target, over all slots up to ``until``."""
    done, worst = dict.fromkeys(targets, 0), Fraction(0)
    for t in range(until):
        done[slots[t][0]] += 1
        worst = max(worst, *(abs(done[s] - (t + 1) * x) for s, x in targets.items()))
    return worst


def test_deviation_from_the_given_weights_stays_below_one_block(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaabbbccd"), "x") for i in range(6000)]
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    out, names = mixing.mix(table(spark, rows), weights, block=4)
    assert names["slot"] == "slot_"
    got = out.collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((i, s) for i, s, _ in rows)
    slots = {}
    for r in got:
        assert r.release <= r.slot_ < r.deadline
        assert slots.setdefault(r.slot_, (r.source, r.block)) == (r.source, r.block)
    last = min(max(t for t, (x, _) in slots.items() if x == s) for s in weights)
    assert [slots[t][0] for t in range(60)] == edf({"a": 10, "b": 6, "c": 3, "d": 1}, 60)
    assert deviations(slots, {s: Fraction(str(w)) for s, w in weights.items()}, last) < 1


def test_fifteen_hundred_sources_and_one_with_half_the_weight(spark):
    rows = [(i, "hot" if i < 12_000 else f"s{i % 1499}", "") for i in range(24_000)]
    weights = {"hot": 0.5} | {f"s{i}": 0.5 / 1499 for i in range(1499)}
    got = mixing.mix(table(spark, rows), weights, block=4)[0].collect()
    assert len(got) == 24_000 and all(r.release <= r.slot_ < r.deadline for r in got)
    of = {r.slot_: (r.source, r.block) for r in got}
    assert len(of) == len({(r.source, r.block) for r in got})
    given = {s: Fraction(str(w)).limit_denominator(mixing.FINEST) for s, w in weights.items()}
    share = given["hot"] / sum(given.values())
    assert abs(share - Fraction(1, 2)) < Fraction(1, 1000)
    done = 0
    for t in range(3000):
        done += of.get(t, ("",))[0] == "hot"
        assert abs(done - (t + 1) * share) < 1


def test_weights_too_fine_for_a_period_take_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 100)
    rows = [(i, "abc"[i * i % 3], "") for i in range(3000)]
    got = mixing.mix(table(spark, rows), {"a": 0.618034, "b": 0.314159}, block=4)[0].collect()
    assert len(got) == 3000 and all(r.release <= r.slot_ < r.deadline for r in got)
    assert max(r.place for r in got) == 31  # 4 doubled until at most 100 blocks are left
    assert len({(r.source, r.block) for r in got}) == len({r.slot_ for r in got}) <= 100


def test_the_order_of_slots_equals_a_plain_simulation():
    weights = [7, 1, 1, 13, 4]
    slots = mixing.earliest_deadlines(weights)
    by = {t: i for i, own in enumerate(slots) for t in own}
    assert [by[t] for t in range(26)] == edf(dict(enumerate(weights)), 26)
    assert mixing.whole_weights([("a", 1), ("b", 5), ("c", 16)], None) == [1, 3, 4]
    assert mixing.whole_weights([("a", 1), ("z", 5)], {"a": 0.2, "b": 0.1}) == [2, 1]


def test_numbers_run_through_blocks_without_gaps(spark):
    rows = [(i % 900, "hot" if i % 3 else None, "") for i in range(5000)] + [(None, "hot", ""), (None, "hot", "")]
    got = mixing.plan(table(spark, rows), block=8).collect()
    assert len(got) == 5002
    for s in ("hot", None):
        at = sorted(r.block * 8 + r.place for r in got if r.source == s)
        assert at == list(range(len(at)))


def test_rows_without_ids_are_spread_and_repeated_ids_have_one_order(spark):
    rows = [(None, "a", f"t{i}") for i in range(600)] + [(5, "a", "x"), (5, "a", "y")] * 3
    docs = table(spark, rows)
    first = {(r.doc_id, r.slot): (r.block, r.place) for r in mixing.mix(docs)[0].collect() if r.doc_id is None}
    again = {(r.doc_id, r.slot): (r.block, r.place) for r in mixing.mix(docs.repartition(7))[0].collect() if r.doc_id is None}
    assert first == again and len(first) == 600
    assert [b for b, _ in (first[None, f"t{i}"] for i in range(600))] != [i // 16 for i in range(600)]


def test_interleave_writes_the_mix_in_file_order(spark, tmp_path):
    rows = [(i, str(i % 5) if i % 4 else "0", "t" * (i % 7)) for i in range(900)]
    df = table(spark, rows)
    out = mixing.interleave(df, block=2)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out.write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", "source", "_metadata.file_name", "_metadata.row_index")
    assert files.select("file_name").distinct().count() > 2
    placed = mixing.mix(spark.read.parquet(f"{tmp_path}/mixed"), block=2)[0].orderBy("slot_", "place").select("doc_id").collect()
    read = files.orderBy(F.col("file_name"), "row_index").select("doc_id").collect()
    assert placed == read
    assert mixing.interleave(table(spark, [])).count() == 0
