"""Tables of many rows with few values: joins stay near the rows they read, and results still equal the SQL."""

import duckdb
import pytest

from rillframe import catalogue
from rillframe.operators import select, spatial


def most_joined(df) -> int:
    """Collects ``df``; the most rows that a join of its plan has made."""
    df.collect()

    def walk(node):
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if kind.endswith("QueryStage"):
            return walk(node.plan())
        kids = node.children()
        most = [walk(kids.apply(i)) for i in range(kids.size())]
        if "Join" in kind or kind == "CartesianProduct":
            most.append(node.metrics().apply("numOutputRows").value())
        return max(most, default=0)

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """A folder with 9,000 customers, 6,000 suppliers and 24,000 parts, and DuckDB over it."""
    folder, con = tmp_path_factory.mktemp("grown"), duckdb.connect()
    for name, sql in {"customer": "select i as c_custkey from range(9000) t(i)", "supplier": "select i as s_suppkey, i * 7 % 25 as s_nationkey from range(6000) t(i)",
                      "part": "select i as p_partkey, 'p' || i % 50 as p_name from range(24000) t(i)"}.items():
        con.execute(f"copy ({sql}) to '{folder}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def same(spark, grown, name):
    folder, con = grown
    df = catalogue.queries()[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    most = most_joined(df)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    return most


def test_links_meet_names_not_bearers(spark, grown):
    assert same(spark, grown, "q_links") <= 9000


def test_counted_candidates_are_those_of_the_list(spark):
    rows = spark.createDataFrame([("a", "N"), ("b", "S"), ("c", "S"), ("d", None)], "dam_id string, name string")
    links = spark.createDataFrame([(1, "a", "S"), (2, "z", "N"), (3, None, "N"), (4, None, "S"), (5, None, "?"), (6, None, None)], "link_id int, dam_id string, name string")
    got = sorted((r.link_id, r.found, r.candidates) for r in select.resolve_counts(links, rows).collect())
    assert got == sorted((r.link_id, r.found, len(r.candidates)) for r in select.resolve(links, rows).collect())


def test_nearest_meets_places_not_rows(spark, grown):
    assert same(spark, grown, "q_nearest") <= 100_000


def test_points_at_one_place_meet_an_edge_once(spark, grown):
    folder, con = grown
    edges = con.execute("select count(*) from supplier").fetchall()[0][0]
    assert same(spark, grown, "q_point_in_ring") <= 1000 * edges / 3  # an edge spans a third of the latitudes


def test_ranked_targets_meet_places_not_rows(spark, grown):
    assert same(spark, grown, "q_tap_rank") <= 2_000_000


def test_keys_on_several_rows_and_places_that_are_unknown(spark):
    """Like SQL over all pairs: a key's rows count together, and a place without coordinates is at no distance."""
    a = [(1, 36.0, 137.0), (1, 36.0, 137.0), (2, 36.0, 137.0), (3, 36.2, 137.0), (3, 36.0, 137.0), (4, None, 137.0), (None, 36.0, 137.0)]
    b = [(9, 36.0, 137.001), (8, 36.0, 137.001), (7, 36.2, 137.0), (6, 36.0, 137.002), (5, None, 137.0)]
    left, right = spark.createDataFrame(a, "x int, lat double, lon double"), spark.createDataFrame(b, "y int, lat double, lon double")
    assert {(r.x, r.y) for r in spatial.nearest(left, right, "x", "y").collect()} == {(1, 8), (2, 8), (3, 7), (4, 5), (None, 8)}
    got = sorted((r.x or 0, r.y, r["rank"]) for r in spatial.nearest_k(left, right, 2, "x", "y").collect())
    assert got == [(0, 8, 1), (0, 9, 2), (1, 8, 1), (1, 8, 2), (2, 8, 1), (2, 9, 2), (3, 7, 1), (3, 8, 2)]
    edges = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (1, 2.0, 2.0, 2.0, 0.0)], "ring int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 3.0, 1.0), (4, None, 1.0), (None, 1.0, 1.0)], "k int, lon double, lat double")
    assert sorted(str(r.k) for r in spatial.points_in_rings(points, edges, "ring", "k", "lon", "lat").collect()) == ["1", "None"]


def test_many_different_places_meet_their_neighbours_alone(spark):
    import random

    rng = random.Random(8)
    rows = lambda n: [(i, 36 + rng.random() / 20, 137 + rng.random() / 20) for i in range(n)]
    a, b = rows(1500) + [(9000, 36.3, 137.3)], rows(3000)
    con = duckdb.connect()
    for name, own in (("a", a), ("b", b)):
        con.execute(f"create table {name} (k int, lat double, lon double)")
        con.executemany(f"insert into {name} values (?, ?, ?)", own)
    left, right = spark.createDataFrame(a, "x int, lat double, lon double"), spark.createDataFrame(b, "y int, lat double, lon double")
    metres = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
    got = spatial.nearest(left, right, "x", "y").select("x", "y")
    assert most_joined(got) < 400_000
    assert sorted(map(tuple, got.collect())) == con.execute(f"select a.k, arg_min(b.k, round({metres}, 3)) from a, b group by 1 order by 1").fetchall()
    km = "sqrt(pow((b.lat - a.lat) * 111, 2) + pow((b.lon - a.lon) * 91, 2))"
    got = spatial.nearest_k(left, right, 3, "x", "y").select("x", "y", "rank")
    assert most_joined(got) < 2_000_000
    assert sorted(map(tuple, got.collect())) == con.execute(
        f"select * from (select a.k, b.k, row_number() over (partition by a.k order by round({km}, 6), b.k) as r from a, b where {km} < 45) where r < 4 order by 1, 2").fetchall()
