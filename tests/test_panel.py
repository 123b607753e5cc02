import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.functions import scalars as sc
from almanac.operators import joins as jn, reshape as rs, splits as sp, surge, timeseries as ts


def series(spark, flags, valid=None):
    rows = [(e, t, f, 1 if valid is None else valid[e][t]) for e, s in flags.items() for t, f in enumerate(s)]
    return spark.createDataFrame(rows, "e int, t int, flag int, valid int")


def brute_min_duration(s, n):
    out, i = [0] * len(s), 0
    while i < len(s):
        j = i
        while j < len(s) and s[j]:
            j += 1
        if j > i and j - i >= n:
            out[i:j] = [1] * (j - i)
        i = max(j, i + 1)
    return out


def brute_onsets(s, r):
    out, last = [0] * len(s), None
    for t, f in enumerate(s):
        if f and (t == 0 or not s[t - 1]) and (last is None or t - last > r):
            out[t], last = 1, t
    return out


def brute_window(s, v, ew):
    y, m = [], []
    for t in range(len(s)):
        w, k = s[t + 1:t + 1 + ew], v[t + 1:t + 1 + ew]
        ok = len(w) == ew and all(k)
        m.append(int(ok))
        y.append(int(ok and any(w)))
    return y, m


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_onsets_and_windows_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    flags = {e: [int(rnd.random() < 0.45) for _ in range(40)] for e in range(12)}
    flags[100], flags[101], flags[102] = [1] * 40, [0] * 40, [0] * 38 + [1, 1]
    valid = {e: [int(rnd.random() < 0.9) for _ in s] for e, s in flags.items()}
    df = series(spark, flags, valid)
    for n in (1, 2, 3):
        got = ts.min_duration(df, "flag", ["e"], "t", n).toPandas()
        for e, s in flags.items():
            assert got[got.e == e].sort_values("t")["flag"].tolist() == brute_min_duration(s, n)
    for r in (0, 1, 2, 5):
        got = ts.onsets(df, "flag", ["e"], "t", r).toPandas()
        for e, s in flags.items():
            assert got[got.e == e].sort_values("t")["onset"].tolist() == brute_onsets(s, r)
    lab = surge.make_labels(df, ["e"], "t", [1, 3, 6]).toPandas()
    for e, s in flags.items():
        for h in (1, 3, 6):
            g = lab[(lab.e == e) & (lab.horizon == h)].sort_values("t")
            assert (g["y"].tolist(), g["m"].tolist()) == brute_window(s, valid[e], h)


def test_refractory_boundary(spark):
    s = [1, 0, 0, 1, 0, 0, 0, 1]  # starts 3 and 4 apart
    got = ts.onsets(series(spark, {1: s}), "flag", ["e"], "t", 3).orderBy("t").toPandas()["onset"].tolist()
    assert got == [1, 0, 0, 0, 0, 0, 0, 1]


def test_episode_lengths_add_up(spark):
    df = series(spark, {1: [1, 1, 0, 1, 0, 0, 1, 1, 1]}).withColumn("z", F.col("t") * 1.0)
    ep = ts.episodes(df, "flag", ["e"], "t", "z").orderBy("start_t").collect()
    assert [(r.start_t, r.end_t, r.length, r.peak) for r in ep] == [(0, 1, 2, 1.0), (3, 3, 1, 3.0), (6, 8, 3, 8.0)]


def month(i):
    return dt.date(2017 + i // 12, i % 12 + 1, 1)


def test_calendar_completion_and_fill(spark):
    df = spark.createDataFrame([(1, month(0), 5.0), (1, month(3), 7.0), (2, month(1), None)], "e int, month date, p double")
    full = ts.complete_months(df, ["e"]).withColumn("f", ts.ffill("p", "e", "month")).orderBy("e", "t").toPandas()
    assert full["t"].tolist() == [0, 1, 2, 3] * 2
    assert full[full.e == 1]["f"].tolist() == [5.0, 5.0, 5.0, 7.0] and full[full.e == 2]["f"].isna().all()


def test_published_sample_counts(spark):
    """35 entities, 84 months, scores from month 12 on."""
    rows = [(e, month(t), t, int(t >= 12), 0) for e in range(35) for t in range(84)]
    p = spark.createDataFrame(rows, "entity int, month date, t int, valid int, flag int")
    lab = surge.make_labels(p, ["entity"], "t", [1, 3])
    counts = {r.horizon: r.valid for r in surge.label_stats(lab, ["horizon"]).collect()}
    assert counts == {1: 2520, 3: 2450}
    long = lab.where("t >= 12").withColumnRenamed("t", "t_end")
    s = sp.mask_policy(long.select("entity", "t_end").distinct(), long, ["entity", "t_end"], "all")
    split = sp.split_next_year(s, p, 2017, 2022, 18, 3)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 1995, "val": 630, "test": 315}
    clean = sp.split_next_year(s, p, 2017, 2022, 18, 3, exclude_val_from_train=True)
    assert clean.where("split = 'train'").count() == 1995 - 630
    w = ts.windows(p, ["valid"], ["entity"], "t", 12, 1)
    assert w.count() == 35 * 72 and {r.n for r in w.select(F.size("steps").alias("n")).distinct().collect()} == {12}


def test_nan_scores_are_neither_flag_nor_valid(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 2.0), (1, 2, None)], "e int, t int, z double")
    got = surge.flag_family(df, [1.0]).orderBy("t").collect()
    assert [(r.flag, r.valid) for r in got] == [(0, 0), (1, 1), (0, 0)]


def test_fixed_baseline_floor(spark):
    rows = [(1, month(t), 100.0 * 1.01 ** t) for t in range(48)]
    df = spark.createDataFrame(rows, "e int, month date, price double")
    z = surge.ifpa_fixed(df, ["e"], y0=2017, y1=2019).orderBy("month").toPandas()["z"]
    assert z[:12].isna().all() and (z[12:].abs() < 1e-6).all()


def test_walk_forward_never_sees_the_future(spark):
    s = spark.range(60).select(F.col("id").cast("int").alias("t_end"))
    wf = sp.walk_forward(s, F.lit(59), 3, F.lit(30), stride=5, window=20, val_window=6).toPandas()
    past = wf[wf.role != "score"]
    assert (past["t_end"] + 3 <= past["origin"]).all()
    assert (wf[wf.role == "score"]["t_end"] == wf[wf.role == "score"]["origin"]).all()
    assert set(wf["origin"]) == {30, 35, 40, 45, 50, 55}
    assert (wf[wf.role == "val"].groupby("origin").size() == 3).all()


def test_slug_and_names(spark):
    df = spark.createDataFrame([("Côte d'Ivoire",), ("  Guinea-Bissau ",), (None,), ("NA",)], "s string")
    assert [r[0] for r in df.select(sc.slug("s")).collect()] == ["co te d ivoire", "guinea bissau", "", "na"]
    assert sc.label_key(3, 2.0) == "Y_3_thr2" and sc.label_key(1, "thr1.8") == "Y_1_thr1.8" and sc.label_key(1) == "Y_1"


def test_alias_helps_the_code_join(spark):
    names = spark.createDataFrame([("Swaziland",), ("Kenya",), ("Atlantis",)], "name string")
    codes = spark.createDataFrame([("eswatini", "SWZ"), ("kenya", "KEN")], "slug string, code string")
    got = {r.code: r.name for r in jn.resolve_entities([names], codes, codes.limit(0), {"swaziland": "eswatini"}).collect()}
    assert got == {"SWZ": "Swaziland", "KEN": "Kenya"}


def test_scalers(spark):
    pdf = pd.DataFrame({"var": ["a"] * 5 + ["b"] * 5, "value": [1.0, 2, 3, 4, 100] + [7.0] * 5})
    df = spark.createDataFrame(pdf)
    got = rs.Scaler("robust").fit(df).transform(df).toPandas()
    assert abs(got[got["value"] == 100]["scaled"].iloc[0] - 97 / (2 + 1e-6)) < 1e-9 and (got[got["var"] == "b"]["scaled"] == 0).all()
    z = rs.Scaler("zscore").fit(df).transform(df).toPandas()
    assert (z[z["var"] == "b"]["scaled"] == 0).all() and abs(z[z["var"] == "a"]["scaled"].std() - 1) < 1e-9
    with pytest.raises(ValueError):
        rs.Scaler("other")


def test_annual_values_arrive_a_year_late(spark):
    p = spark.createDataFrame([(1, month(t)) for t in range(36)], "e int, month date")
    a = spark.createDataFrame([(1, 2017, 5.0), (1, 2018, 6.0)], "e int, year int, v double")
    got = jn.replicate_annual(a, p, ["e"]).orderBy("month").toPandas()["v"].tolist()
    assert pd.isna(got[:12]).all() and got[12:24] == [5.0] * 12 and got[24:] == [6.0] * 12


def test_interpolation_respects_the_gap_limit(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1.0, None, 3.0, None, None, None, 7.0, None])], "e int, t int, v double")
    got = df.withColumn("i", ts.interpolate("v", "e", "t", 2)).orderBy("t").toPandas()["i"].tolist()
    assert got[:3] == [1.0, 2.0, 3.0] and pd.isna(got[3:6]).all() and got[6] == 7.0 and pd.isna(got[7])


def test_empty_frames(spark):
    df = spark.createDataFrame([], "e int, t int, flag int, valid int")
    assert surge.make_labels(ts.onsets(df, "flag", ["e"], "t", 2), ["e"], "t", [1, 3]).count() == 0
    assert ts.episodes(df.withColumn("z", F.lit(1.0)), "flag", ["e"], "t", "z").count() == 0
