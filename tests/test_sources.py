import pathlib

import pytest
from pyspark.sql import functions as F

from almanac.operators import cube as cb, joins as jn, multirate as mr, pairs as pr, reshape as rs
from almanac.session import new_path
from almanac.sources import tables as src


def test_code_na_stays_text(spark):
    path = new_path(spark, "master")
    spark.createDataFrame([(516, "Namibia", "NA"), (4, "None", None)], "m49 int, name string, iso2 string").coalesce(1).write.csv(path, header=True)
    got = {r.m49: r.iso2 for r in src.read_csv(spark, path, "m49 INT, name STRING, iso2 STRING").collect()}
    assert got == {516: "NA", 4: None}


def test_catalog_takes_the_last_path(spark):
    path = new_path(spark, "files")
    for sub, name in (("a", "Density_FISH_201701.txt"), ("b", "Density_FISH_201701.txt"), ("a", "Density_ALL_201702.txt"), ("a", "notes.txt")):
        folder = pathlib.Path(path.removeprefix("file:")) / sub
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("x")
    got = {(r.code, r.yyyymm): r.path for r in src.catalog(spark, path, r"Density_([A-Za-z]+)_(\d{6})").collect()}
    assert set(got) == {("fish", "201701"), ("all", "201702")} and "/b/" in got[("fish", "201701")]


def test_meta_defaults(spark):
    path = new_path(spark, "meta")
    src.write_meta(spark.createDataFrame([(84, None)], "periods int, scaler string"), path)
    r = src.read_meta(spark, path, "periods INT, scaler STRING, window_len INT", {"scaler": "robust", "window_len": 12}).first()
    assert (r.periods, r.scaler, r.window_len) == (84, "robust", 12)


def test_availability_policies(spark):
    cat = spark.createDataFrame([("2017-01-01", "a"), ("2017-01-01", "b"), ("2017-02-01", "a")], "month string, code string").withColumn("month", F.to_date("month"))
    assert jn.availability(cat, cat, ["a", "b"], "nan").where("present = 0").count() == 1
    assert jn.availability(cat, cat, ["a", "b"], "skip").select("month").distinct().count() == 1
    with pytest.raises(ValueError):
        jn.availability(cat, cat, ["a", "b"], "error")


def test_tiles_and_stencil(spark):
    cells = [("2017-01-01", "a", y, x, float(y * 5 + x)) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(cells, "month string, c string, y int, x int, v double")
    got = {(r.ty, r.tx): r.tile for r in cb.tile_mean(df, 5, 5, 2).collect()}
    assert len(got) == 16 and got[(0, 0)] == (0 + 1 + 5 + 6) / 4 and got[(3, 3)] == (18 + 19 + 23 + 24) / 4
    s = {(r.y, r.x): r.v for r in cb.stencil3(df, 5, 5, {(0, 0): 0.5, (0, 1): 0.5}).collect()}
    assert s[(0, 0)] == 0.5 * 0 + 0.5 * 1 and s[(4, 4)] == 12.0
    v = cb.tile_vector(cb.tile_mean(df, 5, 5, 2)).first()["vec"]
    assert len(v) == 16 and v[0] == 3.0
    dense = cb.to_dense(df.where("v > 3"), ["a"], 5, 5)
    assert dense.count() == 25 and dense.where("v = 0").count() == 4


def test_ping_hours_are_capped(spark):
    h = 3_600_000_000
    p = spark.createDataFrame([(1, 0, 1, "m", "t", 1.0, 1.0), (1, 2 * h, 2, "m", "t", 1.0, 1.0), (1, 50 * h, 3, "m", "t", 30.0, 1.0), (2, 0, 4, "m", "t", 1.0, 1.0)],
                              "vessel int, us bigint, ping_id int, month string, cls string, x double, y double")
    got = {(r.cy, r.cx): r.hours for r in cb.ping_density(p, 10.0, 6.0).collect()}
    assert got == {(0, 0): 2.0, (0, 3): 6.0}


def test_reconciliation_is_coherent(spark):
    b = spark.createDataFrame([("p", "a", 10.0, 1.0, 40.0, 2.0), ("p", "b", 20.0, 3.0, 40.0, 2.0), ("q", "c", 5.0, 1.0, None, None)],
                              "p string, c string, v double, var double, tot double, tv double")
    got = {r.c: r.reconciled for r in mr.reconcile(b, ["p"], "v", "var", "tot", "tv").collect()}
    assert abs(got["a"] - (10 + 10 / 6)) < 1e-9 and abs(got["b"] - (20 + 30 / 6)) < 1e-9 and got["c"] == 5.0


def test_diffusion_keeps_constants(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 2.0), ("c", "a", 1.0)], "src string, dst string, w double")
    x = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "node string, x double")
    out = mr.diffuse(e, x, 3).toPandas()
    assert (out["forward"].round(9) == 1).all() and (out["backward"].round(9) == 1).all() and len(out) == 9


def test_paging_layout(spark):
    assert pr.lines_per_column() == 176
    df = spark.createDataFrame([(i, j) for i in range(20) for j in range(i, 20)], "i_idx bigint, j_idx bigint")
    got = pr.paginate(df, 10, 3, 20).orderBy("i_idx", "j_idx").toPandas()
    assert got["page"].tolist() == [k // 30 + 1 for k in range(210)] and got["col"].tolist() == [k % 30 // 10 + 1 for k in range(210)]
    with pytest.raises(ValueError):
        pr.guarded_export(df, "all")


def test_dedupe_and_sets(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k int, o int, v string")
    assert {(r.k, r.v) for r in rs.dedupe(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "b")}
    a, b = df.select("k"), spark.createDataFrame([(2,), (9,)], "k int")
    sizes = {k: rs.set_op(a, b, k).count() for k in ("concat", "union", "intersect", "difference")}
    assert sizes == {"concat": 5, "union": 3, "intersect": 1, "difference": 1}
