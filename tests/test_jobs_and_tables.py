import numpy as np

from rillframe import jobs
from rillframe.functions import tables
from rillframe.kernels import terrain, tiles
from tests.test_catchments import bowl


def test_table_functions(spark):
    tables.register(spark)
    fd = np.full((3, 5), 2, np.int8)
    fd[1, 3] = 3
    fd[2, 4] = -1
    spark.createDataFrame([(1, bytearray(terrain.pack_directions(fd)), 1, 0), (2, None, 0, 0)], "k int, d8 binary, i int, j int").createOrReplaceTempView("g")
    got = [tuple(r) for r in spark.sql("SELECT k, t.* FROM g, LATERAL d8_trace(d8, 3, 5, i, j, 100) t ORDER BY pos").collect()]
    assert got == [(1, 0, 1, 0, 0.0), (1, 1, 1, 1, 1.0), (1, 2, 1, 2, 2.0), (1, 3, 1, 3, 3.0), (1, 4, 2, 4, 3.0 + 1.4142)]
    near = spark.sql("SELECT * FROM tiles_around(36.6D, 137.0D, 14, 1)").collect()
    x, y = (int(v) for v in tiles.xy(36.6, 137.0, 14))
    assert len(near) == 9 and tuple(near[0]) == (x - 1, y - 1) and tuple(near[-1]) == (x + 1, y + 1)


def test_jobs(spark, tmp_path, capsys):
    x, y = (int(v) for v in tiles.xy(36.6, 137.0, 14))
    cells = [(14, x + a, y + b, bytearray(bowl(a + 2, b + 2).tobytes())) for a in range(-2, 3) for b in range(-2, 3)]
    spark.createDataFrame(cells, "z int, x int, y int, cells binary").write.parquet(f"{tmp_path}/tiles")
    spark.createDataFrame([("a-1", "North", 1, 36.6, 137.0, 1.0, None)], "dam_id string, name string, ord int, lat double, lon double, sizing_km2 double, official_km2 double").write.parquet(f"{tmp_path}/dams")
    base = ["delineate", "--dams", f"{tmp_path}/dams", "--tiles", f"{tmp_path}/tiles", "--out", f"{tmp_path}/out"]
    assert jobs.main(base, spark) == 2 and jobs.main([*base, "--id", "zz"], spark) == 2
    assert "unknown: zz" in capsys.readouterr().err
    assert jobs.main([*base, "--pref", "a"], spark) == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 1
    pub = ["publish", "--table", f"{tmp_path}/dams", "--root", f"file://{tmp_path}/pub", "--name", "dams", "--key", "dam_id"]
    assert jobs.main(pub, spark) == 0 and jobs.main(pub, spark) == 0
    assert capsys.readouterr().out.split()[1::2] == ["written", "unchanged"]
