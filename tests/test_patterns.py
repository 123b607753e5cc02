import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from almanac.operators import joins as jn, multirate as mr, reliability as rl
from almanac.operators.patterns import (cut_points, global_index, previous_value, quantiles, running_sums, with_segment)


def skewed(spark, n=4000, seed=1):
    """Rows of which a third belong to one key; positions repeat."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 7, rng.integers(0, 40, n))
    pdf = pd.DataFrame({"k": key, "x": rng.integers(0, n // 2, n).astype(float), "id": np.arange(n), "v": rng.integers(0, 50, n)})
    return pdf, spark.createDataFrame(pdf)


def test_segments_follow_the_cuts(spark):
    pdf, df = skewed(spark)
    cuts = cut_points(df, "x", 8)
    assert cuts == sorted(set(cuts)) and len(cuts) == 7
    got = with_segment(df, "x", cuts).toPandas()
    assert (got["_seg"] == np.searchsorted(cuts, got["x"], side="right")).all()
    assert got.groupby("_seg").size().max() < len(pdf) / 3
    assert with_segment(df, "x", []).select("_seg").distinct().count() == 1


def test_running_sums_equal_pandas_cumsum(spark):
    pdf, df = skewed(spark)
    got = running_sums(df, ["k"], "x", {"v": "v"}, ["x", "id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["k", "x", "id"])
    want = want.assign(c=want.groupby("k")["v"].cumsum(), t=want.groupby("k")["v"].transform("sum")).sort_values("id")
    assert (got["cum_v"].values == want["c"].values).all() and (got["tot_v"].values == want["t"].values).all()


def test_running_sums_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), (1, 1.0, 5)], "k int, x double, v int")
    got = {(r.k, r.x): (r.cum_v, r.tot_v) for r in running_sums(df, ["k"], "x", {"v": "v"}).collect()}
    assert got == {(None, 1.0): (2, 5), (None, 2.0): (5, 5), (1, 1.0): (5, 5)}


def test_global_index_is_the_sorted_position(spark):
    pdf, df = skewed(spark)
    got = global_index(df, "x", ["x", "id"]).orderBy("idx").toPandas()
    assert (got["idx"] == np.arange(len(pdf))).all()
    assert (got["id"].values == pdf.sort_values(["x", "id"])["id"].values).all()


def test_previous_value_over_a_hot_key(spark):
    pdf, df = skewed(spark)
    d = df.withColumn("val", F.when(F.col("v") < 5, F.col("id")))
    got = previous_value(d, ["k"], "x", ["x", "id"], "val", "prev").toPandas().set_index("id")["prev"]
    p = pdf.assign(val=pdf["id"].where(pdf["v"] < 5)).sort_values(["k", "x", "id"])
    want = p.assign(w=p.groupby("k")["val"].transform(lambda s: s.ffill().shift(1))).set_index("id")["w"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_quantiles_match_numpy(spark):
    pdf, df = skewed(spark)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.q): r.value for r in quantiles(df, ["k"], "x", qs).collect()}
    for k, g in pdf.groupby("k"):
        for q in qs:
            assert abs(got[(k, q)] - np.quantile(g["x"], q)) < 1e-9
    even = [i / 199 for i in range(200)]
    one = {r.q: r.value for r in quantiles(df, [], "x", even).collect()}
    assert len(one) == 200 and all(abs(one[q] - np.quantile(pdf["x"], q)) < 1e-9 for q in even)


def test_quantiles_of_one_row_and_of_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("b", float("nan"))], "k string, x double")
    got = quantiles(df, ["k"], "x", [i / 199 for i in range(200)]).collect()
    assert {r.k for r in got} == {"a"} and len(got) == 200 and {r.value for r in got} == {3.0}


def test_asof_join_matches_merge_asof(spark):
    pdf, df = skewed(spark)
    left, right = pdf[pdf["v"] < 25], pdf[pdf["v"] >= 25].drop_duplicates(["k", "x"])
    got = jn.asof_join(spark.createDataFrame(left[["k", "x", "id"]]), spark.createDataFrame(right[["k", "x", "id", "v"]]), ["k"], "x", "id", tol=100)
    want = pd.merge_asof(left.sort_values("x")[["k", "x", "id"]], right.sort_values("x")[["k", "x", "v"]], on="x", by="k", tolerance=100)
    g = got.toPandas().sort_values("id")["r_v"].values
    w = want.sort_values("id")["v"].values
    assert len(g) == len(w) and ((g == w) | (pd.isna(g) & pd.isna(w))).all()


def test_nearest_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    o = pd.DataFrame({"id": range(500), "mile": rng.integers(0, 3000, 500).astype(float)})
    a = pd.DataFrame({"asset": range(60), "mile": rng.integers(0, 3000, 60).astype(float)})
    got = jn.nearest_join(spark.createDataFrame(o), spark.createDataFrame(a), "mile", "id", "asset").toPandas().set_index("id")
    for i, m in zip(o["id"], o["mile"]):
        b = a.assign(d=(a["mile"] - m).abs()).sort_values(["d", "mile", "asset"]).iloc[0]
        assert got.loc[i, "nearest"] == b["asset"] and got.loc[i, "distance"] == b["d"]


def test_interval_join_meets_every_pair_once(spark):
    rng = np.random.default_rng(4)
    base = np.datetime64("2024-01-01")
    obs = pd.DataFrame({"o": range(300), "day": base + rng.integers(0, 20, 300), "mile": rng.integers(0, 60, 300)})
    iv = pd.DataFrame({"n": range(80), "s": base + rng.integers(0, 15, 80), "lo": rng.integers(0, 50, 80)})
    iv["e"], iv["hi"] = iv["s"] + pd.to_timedelta(rng.integers(0, 6, 80), "D"), iv["lo"] + rng.integers(0, 25, 80)
    do = spark.createDataFrame(obs.assign(day=obs["day"].dt.date))
    di = spark.createDataFrame(iv.assign(s=iv["s"].dt.date, e=iv["e"].dt.date))
    got = {(r.o, r.n) for r in jn.interval_join(do, di, "day", "mile", "s", "e", "lo", "hi").collect()}
    x = obs.merge(iv, how="cross")
    x = x[(x["day"] >= x["s"]) & (x["day"] <= x["e"]) & (x["mile"] >= x["lo"]) & (x["mile"] <= x["hi"])]
    assert got == set(zip(x["o"], x["n"])) and jn.interval_join(do, di, "day", "mile", "s", "e", "lo", "hi").count() == len(x)


def test_sessionise_hot_key(spark):
    pdf, df = skewed(spark)
    d = df.withColumn("us", F.col("x").cast("bigint"))
    got = mr.sessionise(d, ["k"], "us", "id", 20).toPandas().set_index("id")["session"].sort_index()
    p = pdf.sort_values(["k", "x", "id"])
    new = p.groupby("k")["x"].diff().isna() | (p.groupby("k")["x"].diff() > 20)
    want = new.groupby(p["k"]).cumsum()
    want.index = p["id"]
    assert (got.values == want.sort_index().values).all()


def test_average_rank_matches_pandas(spark):
    pdf, df = skewed(spark)
    got = rl.avg_rank(df, "v", "r").toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(got.values, pdf["v"].rank().values)


def test_null_and_nan_positions_are_kept(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 2.0, 2), (1, float("nan"), 3), (1, 5.0, 4), (1, 9.0, 5)], "k int, x double, v int")
    got = running_sums(df, ["k"], "x", {"v": "v"}, ["x", "v"]).orderBy("cum_v").toPandas()
    assert got["v"].tolist() == [1, 2, 4, 5, 3] and got["cum_v"].tolist() == [1, 3, 7, 12, 15]
    prev = previous_value(df, ["k"], "x", ["x", "v"], "v", "p").toPandas().set_index("v")["p"]
    assert pd.isna(prev[1]) and prev[2] == 1 and prev[4] == 2 and prev[5] == 4 and prev[3] == 5
    assert global_index(df, "x", ["x", "v"]).count() == 5


def test_rows_tied_on_one_value_are_spread(spark):
    """A third of all rows on one value: their ties are cut along the next column of the order."""
    from almanac.operators.patterns import SEG, cuts_and_ties, with_segment

    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 5.0D else id / 1000D + 2 * (id % 2) + 3 end as x", "1L as one")
    cuts, ties = cuts_and_ties(df, "x", ["x", "id"])
    assert list(ties) == [5.0]
    seg = with_segment(df, "x", cuts, ties=ties)
    assert max(r["count"] for r in seg.where("x = 5").groupBy(SEG).count().collect()) < 600
    assert [r["id"] for r in seg.orderBy(SEG, "x", "id").collect()] == [r["id"] for r in df.orderBy("x", "id").collect()]
    rank = running_sums(df, [], "x", {"one": "n"}, ["x", "id"]).orderBy("x", "id").collect()
    assert [r["cum_n"] for r in rank] == list(range(1, 3001))
    last = previous_value(df, [], "x", ["x", "id"], "id", "before").orderBy("x", "id").collect()
    assert [r["before"] for r in last[1:]] == [r["id"] for r in last[:-1]] and last[0]["before"] is None
