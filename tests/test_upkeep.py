import pytest
from pyspark.sql import functions as F

from rillframe import publish
from rillframe.operators import basins, ingest, spatial, upkeep
from rillframe.operators.spatial import nearest


def test_settings_take_defaults_and_refuse_unknown_keys():
    assert upkeep.settings('{"_remark": 1, "notice": 9}', {"notice": 7, "warn": 14}) == {"notice": 9, "warn": 14}
    assert upkeep.settings("", {"warn": 14}) == {"warn": 14}
    with pytest.raises(KeyError):
        upkeep.settings('{"wran": 1}', {"warn": 14})


def test_a_broken_batch_goes_on_where_it_stopped(spark, tmp_path):
    todo, seen, path = spark.range(40).withColumnRenamed("id", "dam_id"), [], f"{tmp_path}/profiles"

    def work(part):
        ids = sorted(r.dam_id for r in part.collect())
        seen.append(ids)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return part.withColumn("km2", F.col("dam_id") * 2.0)

    with pytest.raises(RuntimeError):
        upkeep.resumed(todo, path, "dam_id", work)
    done = set(sum(seen[:2], []))
    out = upkeep.resumed(todo, path, "dam_id", work)
    assert sorted(r.dam_id for r in out.collect()) == list(range(40))
    assert not done & set(sum(seen[3:], []))


def test_markers_that_are_missing_are_an_error(spark):
    df = spark.createDataFrame([("a <!-- b -->x<!-- e --> z",)], "body string")
    put = lambda b, e: df.select(upkeep.replaced_between(F.col("body"), b, e, F.lit("new")).alias("x")).first().x
    assert put("<!-- b -->", "<!-- e -->") == "a <!-- b -->new<!-- e --> z"
    for b, e in (("<!-- e -->", "<!-- b -->"), ("<!-- c -->", "<!-- e -->"), (" ", "z")):
        with pytest.raises(Exception, match="markers"):
            put(b, e)


def test_assembly_stops_on_strays_and_faults(spark):
    row = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    import hashlib

    v = hashlib.sha256(b"c").hexdigest()[:12]
    tables = {
        "dams": row("dam_id string, ord int", ("a", 1), ("b", 2)), "states": row("dam_id string, published_version string, published_method string", ("a", v, "exact"), ("b", None, None)),
        "approvals": row("dam_id string, version string", ("a", v)), "holds": row("dam_id string, reason string"), "notes": row("dam_id string, note string", ("a", "n")),
        "flows": row("dam_id string, version string, content string", ("a", v, "c"))}
    assert [r.dam_id for r in publish.assemble(**tables)["public"].collect()] == ["a"]
    for name, bad, what in (("approvals", ("z", v), "not registered"), ("flows", ("b", v, "c"), "orphan"), ("notes", ("q", "n"), "not registered")):
        with pytest.raises(ValueError, match=what):
            publish.assemble(**(tables | {name: tables[name].unionByName(row(tables[name].schema, bad))}))
    held = tables | {"holds": row("dam_id string, reason string", ("a", "why"))}
    out = publish.assemble(**held)
    assert out["public"].count() == 0 and out["candidates"].first().hold_reason == "why" and "hold_reason" not in out["public"].columns
    with pytest.raises(ValueError, match="changed"):
        publish.assemble(**(tables | {"flows": row("dam_id string, version string, content string", ("a", v, "other"))}))


def test_the_basin_registry_loads_or_names_what_is_wrong(spark):
    schema = "line int, dam_id string, total_km2 string, direct_km2 string, indirect_km2 string, basin_status string, source string, number_in_source string"
    known = spark.createDataFrame([("a",), ("b",)], "dam_id string")
    good = spark.createDataFrame([(2, "a", "", " 4.5", "", "", "yearbook", ""), (3, "b", "", "", "", "", "", "")], schema)
    assert [(r.dam_id, r.basin_status, r.direct_km2) for r in basins.load(good, known).orderBy("dam_id").collect()] == [("a", "confirmed", 4.5), ("b", "unconfirmed", None)]
    with pytest.raises(ValueError, match="line 4: number_unconfirmed"):
        basins.load(good.unionByName(spark.createDataFrame([(4, "c", "", "1", "", "unconfirmed", "", "")], schema)), known)


def test_neighbours_across_the_date_line(spark):
    left = spark.createDataFrame([(1, 10.0, 179.9995), (2, 10.0, -179.999)], "a int, lat double, lon double")
    right = spark.createDataFrame([(7, 10.0, -179.9996), (8, 10.03, 179.9995), (9, 10.0, 0.0)], "b int, lat double, lon double")
    got = {r.a: (r.b, round(r.metres)) for r in nearest(left, right, "a", "b").collect()}
    assert got[1][0] == 7 and got[1][1] < 110 and got[2][0] == 7
    few = {(r.a, r.b) for r in spatial.nearest_k(left, right, 1, "a", "b").collect()}
    assert few == {(1, 8), (2, 7)}


def test_a_season_needs_a_level_and_two_days(spark):
    rows = [(1.0, "2001/06/15 00:00", "2002/09/30 00:00"), (None, "2001/06/15 00:00", "2002/09/30 00:00"), (1.0, "", "2002/09/30 00:00"), (1.0, "2001/06/15 00:00", "never")]
    df = spark.createDataFrame(rows, "l double, a string, b string").select(ingest.season_of(F.col("l"), F.col("a"), F.col("b")).alias("s"))
    got = [r.s for r in df.collect()]
    assert (got[0].start_md, got[0].end_md) == ("06-15", "09-30") and got[1:] == [None] * 3
