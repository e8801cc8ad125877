import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rillframe import publish, visits
from rillframe.sources import registry, remote
from rillframe.sources import tiles as tile_source
from rillframe.streaming import slots


def test_csv_with_a_mark_and_missing_columns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "dams.csv").write_text("﻿dam_name,lat\nx,1\n", encoding="utf-8")
    (tmp_path / "b" / "dams.csv").write_text("dam_name\ny\n", encoding="utf-8")
    keys = spark.createDataFrame([("a", 1), ("c", 2), ("", 3)], "key string, ord int")
    got = registry.registered(spark, keys, f"file://{tmp_path}", "dams.csv", ["dam_name", "lat"]).collect()
    assert [tuple(r) for r in got] == [("x", "1", "a", 1)]


def test_tagged_lists_check_their_schema(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text(json.dumps({"schema": "holds/1", "holds": {"a-1": {"reason": "unclear"}}}))
    read = lambda tag: registry.read_tagged(spark, str(p), tag, "holds", "struct<reason:string>")
    assert [tuple(r) for r in read("holds/1").collect()] == [("a-1", "unclear")]
    with pytest.raises(ValueError):
        read("holds/2")


def test_tiles_prefer_data_then_marks_then_empty_files(spark, tmp_path):
    text = "\n".join([",".join(["2.5"] * 256)] * 256)
    for folder, name, body in (("p", "14/1/1.txt", ""), ("q", "14/1/1.txt", text), ("p", "14/1/2.missing", "x"), ("q", "14/1/2.txt", ""), ("p", "14/1/3.txt", "")):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    got = {(r.x, r.y): (r.kind, r.cells) for r in tile_source.read_tiles(spark, [str(tmp_path / "p"), str(tmp_path / "q")]).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "ok", (1, 2): "missing", (1, 3): "legacy_empty"}
    assert len(got[1, 1][1]) == 256 * 256 * 4


def test_fetch_retries_and_stops_at_gone():
    script, pauses = [OSError("timeout"), OSError("503"), b"ok"], []

    def opener(_):
        x = script.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.fetch("u", opener, sleep=pauses.append) == b"ok" and pauses == [1.0, 2.0]
    script[:] = [remote.Gone("u"), b"never"]
    assert remote.fetch("u", opener) is None and script == [b"never"]
    script[:] = [OSError("a")] * 3
    with pytest.raises(OSError):
        remote.fetch("u", opener, sleep=lambda _: None)
    assert remote.slot_path(dt.datetime(2026, 1, 2, 3, 40)) == "20260102/0340"


def test_json_slots_source(spark):
    spark.dataSource.register(remote.JsonSlots)
    df = spark.read.format("json_slots").option("urls", json.dumps([])).load()
    assert df.count() == 0 and df.columns == ["url", "body"]


def test_states_keep_what_was_published(spark):
    states = spark.createDataFrame([("a", "v1", "exact", "v1", "pass", []), ("b", "w1", "exact", "w1", "pass", [])], publish.STATE)
    results = spark.createDataFrame([("a", "v2", "exact", "hold", ["area_error"]), ("c", "x1", "legacy", "pass", [])],
                                    "dam_id string, version string, method string, status string, block_codes array<string>")
    new = publish.apply_results(states, results)
    rows = {r.dam_id: r for r in new.collect()}
    assert (rows["a"].published_version, rows["a"].latest_version, rows["a"].latest_codes) == ("v1", "v2", ["area_error"])
    assert rows["b"].published_version == "w1" and rows["c"].published_version == "x1"
    approvals = spark.createDataFrame([("a", "v1"), ("b", "w0"), ("z", "q")], "dam_id string, version string")
    holds = spark.createDataFrame([("q",)], "dam_id string")
    index = {r.dam_id: r.release_status for r in publish.release_index(new, approvals, holds).collect()}
    assert index == {"a": "approved", "b": "stale", "c": "not_exact"}
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "dam_id string")
    assert sorted(map(tuple, publish.strays(known, new, approvals, holds).collect())) == [("q", "hold"), ("z", "approval")]


def test_publication_is_versioned_and_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "k int, s string, x double")
    v1, wrote = publish.publish(spark, df, root, "index", "k")
    assert wrote and publish.publish(spark, df.repartition(3).orderBy(F.desc("k")), root, "index", "k") == (v1, False)
    v2, wrote = publish.publish(spark, df.withColumn("x", F.lit(0.0)), root, "index", "k")
    assert wrote and v2 != v1 and publish.read_published(spark, root, "index").where("x = 0").count() == 2
    assert publish.content_version({"a": 1, "version": 9}) == publish.content_version({"version": 1, "a": 1}) != publish.content_version({"a": 2})


def test_backup_round_trip_and_rejections(spark):
    log = spark.createDataFrame([("d1", dt.datetime(2026, 1, 2, 3, 4, 5), "n"), ("d2", dt.datetime(2025, 1, 1), None)], "dam_id string, visited_at timestamp, note string")
    body = visits.export(log).first()["body"]
    files = [("ok", body), ("bad", "{"), ("other", '{"tag":"x","format":1,"visits":[]}'), ("new", '{"tag":"visit-backup","format":9,"visits":[]}'),
             ("secret", '{"tag":"visit-backup","format":1,"visits":[{"dam_id":"d","visited_at":"2026-01-01T00:00:00","lat":"1"}]}'),
             ("part", '{"tag":"visit-backup","format":1,"visits":[{"dam_id":"d3","visited_at":"never"},{"dam_id":"d1","visited_at":"2024-05-05T00:00:00","note":"early"}]}')]
    good, bad = visits.validate(spark.createDataFrame(files, "path string, body string"))
    assert {r.path: r.why for r in bad.collect()} == {"bad": "unreadable", "other": "other_file", "new": "newer_format", "secret": "forbidden_field"}
    merged = {r.dam_id: (r.visited_at.year, r.note) for r in visits.merge(log, good).collect()}
    assert merged == {"d1": (2024, "early"), "d2": (2025, None)}


def test_streams_take_the_newest_reading_and_guard_batches(spark, tmp_path):
    rows = [("s1", dt.datetime(2026, 1, 1, 0, m), "ok", float(m)) for m in (1, 5, 12)] + [("s2", dt.datetime(2026, 1, 1, 0, 3), "ok", 9.0)]
    spark.createDataFrame(rows, "station string, ts timestamp, status string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("station string, ts timestamp, status string, value double").parquet(f"{tmp_path}/in")
    q = slots.latest_by_station(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.station, r.slot_ts.minute): r.value for r in spark.table("latest").collect()}
    assert got == {("s1", 0): 5.0, ("s1", 10): 12.0, ("s2", 0): 9.0}
    seen = []
    slots.guarded(slots.once(stream, ["station", "ts"]), lambda b, e: seen.append(b.count()), f"{tmp_path}/c1").awaitTermination(60)
    assert sum(seen) == 4
    failing = stream.withColumn("status", F.lit("fetch_failed"))
    with pytest.raises(Exception, match="failed"):
        slots.guarded(failing, lambda b, e: None, f"{tmp_path}/c2").awaitTermination(60)
