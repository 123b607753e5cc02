"""Queries against their SQL twins; all of them with ALMANAC_FULL=1, else one or two per family."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare, rows_of

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["flagship_label_stats", "a14_medallion", "b01_slug", "c14_asof_join", "c23_integrity_report", "d04_scaler_robust", "d18_resample_weekly", "e03_ifpa_fixed",
          "e11_onsets", "f06_tile_mean", "g03_split_next_year", "h08_metric_table", "i01_threshold_f1", "j04_pairwise_distance", "k02_report_main", "l02_aurc_augrc",
          "m13_call_features", "n01_tumble", "n07_decide", "o03_knn_all"]
NAMES = list(entry.queries()) if os.environ.get("ALMANAC_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cur = con.execute(sql)
    assert compare(got, rows_of([d[0] for d in cur.description], cur.fetchall())) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
