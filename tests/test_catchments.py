import numpy as np
import pytest
from pyspark.sql import functions as F

from rillframe.kernels import terrain, tiles
from rillframe.operators import catchments
from rillframe.operators.grid import minimax_fill
from rillframe.storage import lineage_cut


def test_tile_coordinates_invert():
    for lat, lon in ((36.6, 137.1), (-12.3, 8.0)):
        x, y = tiles.xy(lat, lon, 13)
        assert tiles.lat_lon(x, y, 13) == pytest.approx((lat, lon), abs=1e-6)


def test_parse_tile_rejects_other_shapes():
    good = "\n".join([",".join(["e"] + ["1.5"] * 255)] * 256)
    cells = tiles.parse_tile(good)
    assert np.isnan(cells[0, 0]) and cells[3, 4] == 1.5 and cells.dtype == np.float32
    for bad in ("", good.rsplit("\n", 1)[0], good.replace("1.5", "x", 1)):
        with pytest.raises(ValueError):
            tiles.parse_tile(bad)
    assert tiles.mosaic({(0, 0): cells, (1, 0): None}, 0, 0, 2, 1).dtype == np.float64


def bowl(x, y):
    i, j = np.indices((256, 256)).astype(float)
    return (np.hypot(i + y * 256 - 600, j + x * 256 - 640) * 0.5 + 3 * np.sin((i + j) / 9)).astype("<f4")


def test_dataframe_program_equals_the_kernel(spark):
    lat, lon = 36.6, 137.0
    z = 14
    cx, cy = (int(v) for v in tiles.xy(lat, lon, z))
    rows = [(z, cx + a, cy + b, None if (a, b) == (2, 2) else bytearray(bowl(a + 2, b + 2).tobytes())) for a in range(-2, 3) for b in range(-2, 3)]
    df = spark.createDataFrame(rows, "z int, x int, y int, cells binary")
    dams = spark.createDataFrame([("a", lat, lon, 1.0, 2.0), ("b", lat, lon, 1.0, None)], "dam_id string, lat double, lon double, sizing_km2 double, official_km2 double")
    planned = catchments.plan_windows(dams)
    assert {(r.zoom, r.pad) for r in planned.collect()} == {(14, 2)}
    got = {r.dam_id: r for r in catchments.delineate(planned, df).collect()}
    dem = tiles.mosaic({(x, y): None if c is None else np.frombuffer(bytes(c), "<f4").reshape(256, 256) for _, x, y, c in rows}, cx - 2, cy - 2, 5, 5)
    fx, fy = tiles.xy(lat, lon, z)
    want = terrain.delineate(dem, int((fy - cy + 2) * 256), int((fx - cx + 2) * 256), tiles.metres_per_cell(lat, z), 2.0)
    a = got["a"]
    assert a.area_km2 == pytest.approx(want.area_km2) and len(a.ring) == len(want.ring) and a.tiles_missing == 1
    assert (terrain.unpack_mask(bytes(a.mask), a.h, a.w) == want.mask).all()
    assert (terrain.unpack_directions(bytes(a.d8), a.h, a.w) == want.directions).all()
    from rillframe.kernels import products

    mpp = tiles.metres_per_cell(lat, z)
    made = products.deliver(dem, want, mpp, want.area_km2)
    facts = dams.select("dam_id", "official_km2", F.lit("none").alias("diversion"), F.lit(None).cast("string").alias("hold"), F.lit(0).alias("legacy_empty_tiles"), F.lit(2).alias("missing_tiles"))
    row = catchments.judge(catchments.delineate(planned, df, delivered=True), facts).where("dam_id = 'a'").first()
    assert (row.factor, row.ch, row.cw) == (made.factor, *made.mask.shape) and (terrain.unpack_mask(bytes(row.coarse_mask), row.ch, row.cw) == made.mask).all()
    assert row.measures == {k: pytest.approx(float(v)) for k, v in products.spatial_measures(made, np.asarray(want.ring, float) / made.factor).items()}
    assert row.gate.status == "hold" and row.gate.block_codes.count("dem_missing_tile") == 2  # one reason a tile
    grown = catchments.delineate_growing(dams, df, lineage_cut(spark, "grow")).collect()
    assert sorted(r.dam_id for r in grown) == ["a", "b"]


def test_kernel_query_grows_windows_for_every_nation(spark, tmp_path, monkeypatch):
    """All 25 nations go to the growing delineation; touching ones come back with wider windows."""
    from rillframe.plans import kernel

    spark.range(25).select(F.col("id").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    asked = []

    def planned(dams, tiles):
        asked.append(dams.count())
        empty = [x.split()[0] for x in catchments.PRODUCT.split(", ") if x.split()[0] not in ("dam_id", "zoom", "pad", "touches_edge")]
        rows = dams.select("dam_id", "zoom", "pad", (F.col("dam_id").isin("n-3", "n-17") & (F.col("pad") < 4)).alias("touches_edge"))
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], catchments.PRODUCT.replace(": ", ":")).schema}
        return rows.select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in empty if n in kinds])

    monkeypatch.setattr(catchments, "delineate", planned)
    got = {r.dam_id: r.pad for r in kernel.q_kernel_delineate(spark, str(tmp_path)).collect()}
    assert asked == [25, 2, 2] and got == {f"n-{i}": 4 if i in (3, 17) else 2 for i in range(25)}


def test_minimax_equals_the_kernel_without_rise(spark, monkeypatch):
    monkeypatch.setattr(terrain, "RISE", 0.0)
    z = np.random.default_rng(2).integers(0, 30, (9, 8)).astype(float)
    df = spark.createDataFrame([(i, j, int(z[i, j])) for i in range(9) for j in range(8)], "i int, j int, z long")
    got = {(r.i, r.j): r.fill for r in minimax_fill(df, lineage_cut(spark, "t")).collect()}
    want = terrain.fill_depressions(z)
    assert all(got[i, j] == want[i, j] for i in range(9) for j in range(8))


def test_tile_keys_are_a_square_around_the_dam(spark):
    dams = spark.createDataFrame([("a", 36.6, 137.0, 200.0, None)], "dam_id string, lat double, lon double, sizing_km2 double, official_km2 double")
    planned = catchments.plan_windows(dams)
    pad = planned.first()["pad"]
    keys = catchments.tile_keys(planned)
    assert keys.count() == (2 * pad + 1) ** 2 and keys.select(F.countDistinct("x")).first()[0] == 2 * pad + 1
