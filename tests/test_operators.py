import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillframe.functions import geo, text
from rillframe.operators import measure, relate, report, rules, season, select


def test_measurements_follow_the_order_of_the_codes(spark):
    rows = [(1.0, 0), (1.0, 140), (1.0, 190), (1.0, None), (1.0, 130), (None, 0)]
    df = spark.createDataFrame(rows, "raw double, code int").select(measure.normalize("raw", "code").alias("m"))
    assert [(r.m.value, r.m.status) for r in df.collect()] == [(1.0, "ok"), (None, "closed"), (None, "missing"), (None, "not_provided"), (None, "not_provided"), (None, "missing")]


def test_gate_boundaries_are_strict(spark):
    base = dict.fromkeys(("area_error_pct", "grid_drift_pct", "official_area", "fine_recompute_pct"), 15.0) | {
        "unreached_pct": 10.0, "mask_far_outside_pct": 2.0, "ring_far_only_pct": 5.0, "path_outside_pct": 2.0, "ring_self_intersections": 0.0, "mask_largest_pct": 95.0,
        "touches_edge": False, "nodata_adjacent": 0, "legacy_empty_tiles": 0, "missing_tiles": 0, "diversion": "none", "outlet_method": "reservoir", "fine_recompute_pct": 1.0}
    measures = {k: F.lit(v) for k, v in base.items()} | {"hold": F.lit(None).cast("string")}
    at = spark.range(1).select(rules.gate(measures).alias("g")).first().g
    assert at.status == "pass" and at.reasons == []
    over = measures | {"area_error_pct": F.lit(-15.1), "mask_largest_pct": F.lit(94.9), "diversion": F.lit("yes"), "missing_tiles": F.lit(1)}
    g = spark.range(1).select(rules.gate(over).alias("g")).first().g
    assert g.block_codes == ["area_error", "mask_fragmented", "dem_missing_tile"] and g.warn_codes == ["diversion_yes"] and g.status == "hold"
    cls = spark.range(1).select(rules.qa_class(F.lit(False), F.array(F.lit("area_error")), F.array().cast("array<string>"))).first()[0]
    assert cls == "HOLD"


def test_rates_seasons_and_diversions(spark):
    c = lambda x: F.lit(x).cast("double")
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(season.reference_rate(c(50), F.lit(True), c(100), c(0), c(0), F.lit(None).cast("boolean"))) == 50.0
    assert one(season.reference_rate(c(50), F.lit(True), c(100), c(60), c(0), F.lit(True))) == 125.0
    assert one(season.reference_rate(c(50), F.lit(True), c(100), c(60), c(0), F.lit(None).cast("boolean"))) is None
    assert one(season.reference_rate(c(50), F.lit(True), c(100), c(100), c(100), F.lit(True))) is None
    assert one(season.in_season(F.lit("01-05"), F.lit("11-01"), F.lit("03-15"))) is True
    none = F.lit(None).cast("double")
    assert one(rules.diversion(F.lit("text"), F.lit(True), F.lit(0), none, c(0), none)) == "yes"
    assert one(rules.diversion(F.lit(""), F.lit(True), F.lit(0), none, c(0), none)) == "none"
    assert one(rules.diversion(F.lit(None).cast("string"), F.lit(False), F.lit(1), none, none, none)) == "unknown"


def test_targets_links_and_versions(spark):
    rows = spark.createDataFrame([("a-1", "North", 2), ("a-2", "South", 1), ("b-1", "South", 3)], "dam_id string, name string, ord int")
    ids = lambda df: [r.dam_id for r in df.collect()]
    assert ids(select.select_targets(rows)) == [] and ids(select.select_targets(rows, prefixes=["a"])) == ["a-2", "a-1"]
    assert ids(select.select_targets(rows, ids=["b-1", "b-1"], name_part="Nor")) == ["a-1", "b-1"]
    with pytest.raises(KeyError):
        select.select_targets(rows, ids=["zz"])
    links = spark.createDataFrame([(1, "a-1", "South"), (2, "zz", "North"), (3, None, "North"), (4, None, "South"), (5, None, "?")], "link_id int, dam_id string, name string")
    got = {r.link_id: (r.found, r.candidates) for r in select.resolve(links, rows).collect()}
    assert got == {1: ("a-1", ["a-1"]), 2: (None, []), 3: ("a-1", ["a-1"]), 4: (None, ["a-2", "b-1"]), 5: (None, [])}
    agree = lambda a, b: spark.range(1).select(select.same_version(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0]
    assert agree(None, "x") and agree("", "x") and agree("x", "x") and not agree("y", "x")
    cache = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 31))], "k int, saved_at timestamp")
    assert [r.k for r in select.fresh(cache, dt.datetime(2026, 2, 1)).collect()] == [2]


def test_asof_takes_the_newest_within_the_tolerance(spark):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    left = spark.createDataFrame([(1, t(50)), (1, t(4)), (2, t(50)), (1, t(51))], "k int, ts timestamp")
    right = spark.createDataFrame([(1, t(5), "a"), (1, t(40), "b"), (1, t(50), "c"), (2, t(0), "d")], "k int, rts timestamp, v string")
    got = sorted((r.k, r.ts.minute, r.v) for r in relate.asof(left, right, "k", "ts", "rts", ["v"], 600).collect())
    assert got == [(1, 4, None), (1, 50, "c"), (1, 51, "c"), (2, 50, None)]


def test_reports(spark):
    rows = spark.createDataFrame([("official", None, False), ("none", "closed", True), ("none", None, False), ("reference", None, True)], "cls string, reason string, other_ok boolean")
    r = report.coverage(rows).first()
    assert (r.total, r.shown, r.dash, r.dash_with_other, r.reasons) == (4, 2, 2, 1, {"closed": 1, "other": 1})
    reg = spark.createDataFrame([("b", 1), ("a", 2)], "pref string, ord int")
    got = report.counts_with_zeros(spark.createDataFrame([("a",), ("a",)], "pref string"), "pref", reg).collect()
    assert [(x.pref, x.n) for x in got] == [("b", 0), ("a", 2)]
    q = spark.createDataFrame([("a", "PASS", ["x"], True), ("b", "HOLD", ["x", "y"], False)], "pref string, cls string, codes array<string>, human boolean")
    assert [tuple(x) for x in report.class_table(q, ["PASS", "HOLD"]).collect()] == [("a", 1, 0, 1), ("b", 0, 1, 1), (None, 1, 1, 2)]
    assert report.code_counts(q).count() == 3 and report.review_load(q).first().pct == 50.0
    tiles = spark.createDataFrame([("a", "ok"), ("a", "missing")], "dam_id string, kind string")
    assert tuple(report.tile_counts(tiles).first()) == ("a", 1, 1, 0)


def test_scalar_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(text.station_code(F.lit(4098), F.lit(7), F.lit(63))) == "0409800700063" and one(text.station_code(F.lit(123456), F.lit(7), F.lit(63))) == "12345600700063"
    assert one(text.html_escape(F.lit("<a href='x'>&</a>"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&lt;/a&gt;" and one(text.url_quote(F.lit("a b/é"))) == "a%20b%2F%C3%A9"
    assert one(text.grouped(F.lit(1234.5))) == "1,234.5"
    m = one(geo.haversine_m(F.lit(36.0), F.lit(137.0), F.lit(36.0), F.lit(138.0)))
    assert abs(m - 89957) < 50 and one(geo.allowance_m(F.lit(1000.0))) == 900.0
    assert abs(one(geo.local_m(F.lit(36.0), F.lit(137.0), F.lit(36.001), F.lit(137.0))) - 111.32) < 1e-6


def test_markdown_and_pictures(spark, tmp_path):
    from rillframe.sources import images

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, s string").orderBy("k")
    assert report.markdown(df) == "| k | s |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        report.markdown(df, 1)
    for n in ("a-1.png", "a-1.jpg.webp", "zz.jpeg", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    known, unknown = images.register(images.list_images(spark, str(tmp_path)), spark.createDataFrame([("a-1",)], "dam_id string"))
    assert [tuple(r) for r in known.collect()] == [("a-1", "a-1.jpg.webp")] and [r.file for r in unknown.collect()] == ["zz.jpeg"]


def test_nearest_equals_all_pairs_near_and_far(spark):
    import math
    import random

    from rillframe.operators import spatial

    rng = random.Random(4)
    place = lambda i: (i, 36 + rng.random() * (0.2 if i % 3 else 9), 137 + rng.random() * (0.2 if i % 3 else 9))
    a, b = [place(i) for i in range(90)] + [(200, 75.0, 10.0)], [place(i) for i in range(60)] + [(300, 80.0, 11.0), (301, 36.0, -170.0)]

    def metres(p, q):
        la, lb = math.radians(p[1]), math.radians(q[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    df = lambda rows, k: spark.createDataFrame(rows, f"{k} int, lat double, lon double")
    got = {r.x: r.y for r in spatial.nearest(df(a, "x"), df(b, "y"), "x", "y").collect()}
    assert got == {p[0]: min((round(metres(p, q), 3), q[0]) for q in b)[1] for p in a}
