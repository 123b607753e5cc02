"""Operators for large inputs against brute force: neighbours, radix selection, dyadic intervals, look-up, pooling, windows, trees."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import cube as cb, decide, dyadic as dy, hierarchy as hi, joins as jn, lookup as lk, nearest as nn, pairs as pr, rolling as ro, selection as se
from almanac.session import new_path

# --- neighbours --------------------------------------------------------------------------------------


def near_by_hand(points, k, tie=lambda p: p[0]):
    out = []
    ok = [p for p in points if all(c is not None and math.isfinite(c) for c in p[1:3])]
    for p in ok:
        d = sorted((round(math.sqrt((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2), 10), tie(q), q[0]) for q in ok if q[0] != p[0])
        out += [(p[0], o, dist, i + 1) for i, (dist, _, o) in enumerate(d[:k])]
    return sorted(out)


def places(kind, n, rng):
    if kind == "grid":  # many equal distances
        return [(float(i % 17), float(i // 17)) for i in range(n)]
    if kind == "hot":  # a third of all points at one place, a third on one line
        return [(1.5, 2.5) if i % 3 == 0 else (0.0, float(rng.integers(0, 40))) if i % 3 == 1 else tuple(rng.standard_normal(2).tolist()) for i in range(n)]
    if kind == "clusters":  # empty space between tight groups, and far outliers
        c = rng.standard_normal((5, 2)) * 1000
        return [tuple((c[i % 5] + 1e-3 * rng.standard_normal(2)).tolist()) if i % 50 else (1e6 * i, -1e5 * i) for i in range(n)]
    return [tuple(rng.standard_normal(2).tolist()) for _ in range(n)]


@pytest.mark.parametrize("kind, n, k, cell", [("normal", 700, 5, 4), ("grid", 400, 4, 4), ("hot", 300, 3, 4), ("clusters", 400, 7, 4), ("normal", 4, 6, 256)])
def test_nearest(spark, kind, n, k, cell):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:04d}", x, y, n - i) for i, (x, y) in enumerate(places(kind, n, rng))] + [("null", None, 1.0, 9001), ("nan", float("nan"), 1.0, 9002), ("minus zero", -0.0, 0.0, 9003)]
    df = spark.createDataFrame(rows, "label string, x double, y double, idx long")
    got = nn.nearest(df, ["x", "y"], k, per_cell=cell)
    assert sorted(map(tuple, got.collect())) == near_by_hand(rows, k)
    if kind == "grid":
        by_idx = nn.nearest(df, ["x", "y"], k, tie="idx", per_cell=cell)
        assert sorted(map(tuple, by_idx.collect())) == near_by_hand(rows, k, lambda p: p[3])


def test_closest_pairs_need_no_matrix(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", i, x, y) for i, (x, y) in enumerate(places("grid", 200, rng) + places("hot", 60, rng))]
    got = [tuple(r) for r in nn.closest(spark.createDataFrame(rows, "label string, idx long, x double, y double"), ["x", "y"], 25).collect()]
    want = sorted((round(math.hypot(b[2] - a[2], b[3] - a[3]), 10), a[1], b[1], a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :])[:25]
    assert got == [(a, b, d) for d, _, _, a, b in want]


# --- radix selection -----------------------------------------------------------------------------------

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2), 2.0, 1.7976931348623157e308, -1.7976931348623157e308, 2.0**1023, np.nextafter(2.0**1023, 0), 0.1, 1 / 3]


def test_bits_keep_the_order(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([HARD, rng.standard_normal(3000), np.ldexp(rng.random(3000) + 0.5, rng.integers(-1070, 1020, 3000)), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1023), 0)])
    x = np.concatenate([x, -x])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = se.with_bits(df, F.col("x"), "k").toPandas()
    raw = np.abs(got["x"].to_numpy()).view(np.int64)
    assert (got["k"].to_numpy() == np.where(got["x"] < 0, -raw, raw)).all()


@pytest.mark.parametrize("few", [0, 100, 1 << 20])
def test_radix_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(se, "FEW", few)
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.standard_normal(2001)] + [("b", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 7.25)] + [(None, float(v)) for v in 10.0 ** rng.integers(-300, 300, 77)]
    rows += [("a", None), ("a", float("nan")), ("b", float("inf")), ("d", None)]
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["q"]): (r["value"], r["n"]) for r in se.radix_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        v = np.array(sorted(x for k, x in rows if k == g and x is not None and math.isfinite(x)))
        for q in qs:
            p = q * (len(v) - 1)
            lo, hi_ = v[math.floor(p)], v[math.ceil(p)]
            want[(g, q)] = (lo + (hi_ - lo) * (p - math.floor(p)), len(v))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_audit_counts_bad_cells(spark):
    rows = [(0, 0, "a", "a", 1, 1, 0.0), (0, 1, "a", "b", 1, 1, 2.0), (0, 2, "a", "c", 1, 2, 0.0), (1, 1, "b", "x", 1, 1, 1e-3), (1, 2, "b", "c", 1, 2, -1.0), (2, 2, "c", "c", 2, 2, None), (0, 3, "a", "d", 1, 2, float("nan")), (1, 3, "b", "d", 1, 2, float("inf"))]
    df = spark.createDataFrame(rows, "i_idx long, j_idx long, i_label string, j_label string, i_year int, j_year int, distance double")
    one = pr.matrix_audit(df).first().asDict()
    kv = {r["key"]: r["value"] for r in pr.audit_pairs(df).collect()}
    assert {k: kv[k] for k in one} == {k: float(v) for k, v in one.items()}
    assert (kv["nan"], kv["inf"], kv["neg"], kv["diag_nonzero"], kv["label_mismatch"]) == (2, 1, 1, 1, 1)
    assert (kv["all_p0"], kv["all_p50"], kv["all_p100"], kv["same_p50"], kv["cross_p100"]) == (-1.0, 0.0, 2.0, 2.0, 0.0)


# --- intervals --------------------------------------------------------------------------------------------


def test_dyadic_blocks_are_few_and_disjoint(spark):
    rnd = random.Random(2)
    spans = [(0, 0), (1, 1), (0, 1023), (1, 1023), (5, 4), (7, 350_000)] + [(a, a + rnd.randrange(2000)) for a in (rnd.randrange(5000) for _ in range(60))]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", dy.blocks(F.col("a"), F.col("b")).alias("k")).collect():
        got = sorted(((x & (1 << 56) - 1) << (x >> 56), ((x & (1 << 56) - 1) + 1) << (x >> 56)) for x in r["k"])
        assert sum(e - s for s, e in got) == max(0, r["b"] - r["a"] + 1)
        assert all(x[1] == y[0] for x, y in zip(got, got[1:])) and (not got or (got[0][0], got[-1][1]) == (r["a"], r["b"] + 1))
        assert len(got) <= 2 * max(1, (r["b"] - r["a"] + 2).bit_length())


def test_dyadic_interval_join(spark):
    rnd = random.Random(6)
    obs = [(i, rnd.choice("uv"), rnd.uniform(-50, 400_000), rnd.uniform(-30, 30)) for i in range(300)] + [(900, "u", None, 1.0), (901, None, 5.0, 1.0), (902, "u", 10.0, 3.0)]
    ivs = [(i, rnd.choice("uv"), s, s + rnd.choice([0.0, 0.5, 30.0, 20_000.0, 390_000.0]), m, m + rnd.uniform(0, 20)) for i in range(120) for s, m in [(rnd.uniform(-60, 300_000), rnd.uniform(-40, 20))]]
    ivs += [(500, "u", 10.0, 10.0, 3.0, 3.0), (501, "u", 9.0, 8.0, -9.0, 9.0), (502, "u", None, 8.0, -9.0, 9.0)]
    o = spark.createDataFrame(obs, "o long, river string, t double, mile double")
    v = spark.createDataFrame(ivs, "n long, river string, s double, e double, lo double, hi double")
    got = sorted((r["o"], r["n"]) for r in dy.interval_join(o, v, [dy.Axis("t", "s", "e", 0.7), dy.Axis("mile", "lo", "hi", 2.5)], ["river"]).collect())
    ok = lambda x, a, b: None not in (x, a, b) and a <= x <= b
    assert got == sorted((x[0], y[0]) for x in obs for y in ivs if x[1] is not None and x[1] == y[1] and ok(x[2], y[2], y[3]) and ok(x[3], y[4], y[5]))


def test_blocks_are_never_broadcast(spark):
    o = spark.createDataFrame([(i, 3.0 * i) for i in range(20)], "o long, t double")
    v = spark.createDataFrame([(i, 2.0 * i, 2.0 * i + 30) for i in range(9)], "n long, s double, e double")
    j = dy.interval_join(o, v, [dy.Axis("t", "s", "e")])
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString()  # both tables are estimated far below the threshold
    assert sorted((r["o"], r["n"]) for r in j.collect()) == sorted((i, k) for i in range(20) for k in range(9) if 2 * k <= 3 * i <= 2 * k + 30)


# --- look-up ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("floor", [0.6, 0.75, 0.9, 1.0])
def test_lookup_equals_comparing_with_every_entry(spark, floor):
    rnd = random.Random(int(floor * 100))
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n)).strip()
    entries = sorted({word(rnd.randrange(1, 16)) for _ in range(400)} - {""})
    said = []
    for _ in range(150):  # entries with edits, and texts of their own
        w = list(rnd.choice(entries))
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
        said.append("".join(w).upper() if rnd.random() < 0.2 else "".join(w))
    lex = spark.createDataFrame([(f"f{i % 3}", "active" if i % 2 else "defensive", e) for i, e in enumerate(entries)], "family string, kind string, entry string")
    u = spark.createDataFrame(list(enumerate([*said, None, "", said[0]])), "id int, phrase string")
    truth = {(r["id"], r["family"], r["kind"]): round(r["score"], 9) for r in jn.lexicon_score(u, lex, floor=floor).collect() if r["score"] > 0}
    got = {(r["id"], r["family"], r["kind"]): (round(r["score"], 9), r["entry"]) for r in lk.lexicon_lookup(u, lex, floor=floor).collect()}
    assert {k: v[0] for k, v in got.items()} == truth and truth
    with pytest.raises(ValueError):
        lk.lexicon_lookup(u, lex, floor=0.5)


def test_pairs_of_scores_side_by_side(spark):
    u = spark.createDataFrame([(1, "mute"), (2, "stopp"), (3, None)], "id int, phrase string")
    lex = spark.createDataFrame([("tv", "active", "mute"), ("tv", "defensive", "stop"), ("oven", "active", "stop")], "family string, kind string, entry string")
    long = {(r["id"], r["family"], r["kind"]): r["score"] for r in jn.lexicon_score(u, lex).collect()}
    for r in jn.lexicon_pairs(u, lex).collect():
        assert r["s_act"] == long.get((r["id"], r["family"], "active"), 0.0) and r["s_def"] == long.get((r["id"], r["family"], "defensive"), 0.0)


# --- grids ----------------------------------------------------------------------------------------------------


def test_pooling_and_smoothing_by_blocks(spark):
    rng = np.random.default_rng(8)
    h, w = 23, 31
    grid = np.where(rng.random((2, h, w)) < 0.3, rng.integers(1, 9, (2, h, w)), 0).astype(float)
    rows = [("2020-01-01", "ab"[c], int(y), int(x), float(grid[c, y, x])) for c, y, x in zip(*np.nonzero(grid))] + [("2020-02-01", "a", 0, 0, 4.0), ("2020-02-01", "a", 99, 0, 4.0)]
    df = spark.createDataFrame(rows, "month string, c string, y int, x int, v double")
    for patch, block in ((6, 8), (5, 5), (40, 4), (1, 7)):
        p = min(patch, h, w)
        s = max(1, p // 2)
        got = {tuple(r[:4]): r[4] for r in cb.tile_mean(df, h, w, patch, block=block).collect()}
        want = {("2020-01-01", "ab"[c], a, b): grid[c, a * s : a * s + p, b * s : b * s + p].sum() / p / p for c in range(2) for a in range((h - p) // s + 1) for b in range((w - p) // s + 1)}
        want |= {("2020-02-01", c, a, b): 4.0 / p / p if (c, a, b) == ("a", 0, 0) else 0.0 for _, c, a, b in want}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    weights = {(-1, 0): 0.5, (0, 0): 1.0, (1, 1): 0.25}
    got = {tuple(r[:4]): r[4] for r in cb.stencil3(df.where("month < '2020-02-01'"), h, w, weights, block=6).collect()}
    want = {}
    for c, y, x in zip(*np.nonzero(grid)):
        for (a, b), k in weights.items():
            if 0 <= y - a < h and 0 <= x - b < w:
                key = ("2020-01-01", "ab"[c], int(y - a), int(x - b))
                want[key] = want.get(key, 0.0) + k * grid[c, y, x]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# --- windows ----------------------------------------------------------------------------------------------------


def test_window_quantiles_of_long_windows():
    rng = np.random.default_rng(5)
    x = np.where(rng.random(30_000) < 0.1, np.nan, rng.integers(0, 500, 30_000) / 8)
    got = ro.window_quantiles(x, 10_000, 0.9)
    for i in [0, 1, 2, 77, 9_999, 10_000, 10_001, 29_999]:
        past = x[max(0, i - 10_000) : i]
        past = past[~np.isnan(past)]
        assert np.isnan(got[i]) if not len(past) else got[i] == pytest.approx(np.quantile(past, 0.9))


def test_rolling_quantile_over_chunks(spark):
    rng = np.random.default_rng(9)
    rows = [(k, t, None if rng.random() < 0.2 else float(rng.integers(0, 20))) for k, n in (("a", 400), ("b", 3), (None, 60)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    for periods, chunk in ((7, 16), (30, 16), (1, 1000)):
        got = {(r["k"], r["t"]): r["q"] for r in ro.rolling_quantile(df, ["k"], "t", "v", 0.8, periods, "q", chunk).collect()}
        assert len(got) == len(rows)
        for k, t, _ in rows:
            past = [v for key, u, v in rows if key == k and t - periods <= u < t and v is not None]
            assert got[(k, t)] == (None if not past else pytest.approx(np.quantile(past, 0.8)))


# --- hierarchy --------------------------------------------------------------------------------------------------------


def test_tree_equals_dense_least_squares(spark):
    rng = np.random.default_rng(6)
    nodes = [("t", None, 0)] + [(f"r{i}", "t", 1) for i in range(3)] + [(f"n{i}", f"r{i % 2}", 2) for i in range(5)] + [(f"s{i}", f"n{i % 4}", 3) for i in range(11)]
    rows = [(n, p, lv, float(rng.normal(100, 30)), float(rng.uniform(1, 50))) for n, p, lv in nodes]
    rows = [(n, p, lv, y, None if n in ("r0", "n1") else 0.0 if n == "n2" else v) for n, p, lv, y, v in rows]
    got = {r["node"]: r["reconciled"] for r in hi.reconcile_tree(spark.createDataFrame(rows, "node string, parent string, level int, value double, var double"), 3).collect()}
    inner = {p for _, p, *_ in rows}
    leaves = [r[0] for r in rows if r[0] not in inner]
    parent = {r[0]: r[1] for r in rows}
    s = np.zeros((len(rows), len(leaves)))
    for j, leaf in enumerate(leaves):
        n = leaf
        while n is not None:
            s[[r[0] for r in rows].index(n), j] = 1
            n = parent[n]
    w = np.array([0 if r[4] is None else 1e12 if r[4] == 0 else 1 / r[4] for r in rows])
    y = np.array([r[3] for r in rows])
    x = s @ np.linalg.lstsq(s * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    for r, v in zip(rows, x):
        assert got[r[0]] == pytest.approx(v, abs=1e-4)
    for n in inner - {None}:
        assert got[n] == pytest.approx(sum(got[c] for c, p, *_ in rows if p == n), abs=1e-9)


# --- alerts -----------------------------------------------------------------------------------------------------------


def test_alert_report(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 3]), rnd.choice(["m1", "m2"]), rnd.randrange(2), rnd.randrange(2), rnd.random(), None) for _ in range(200)]
    rows = [(h, m, y, k, p, {1: 0.7, 3: None}[h]) for h, m, y, k, p, _ in rows]
    got = {(r["horizon"], r["month"]): tuple(r)[2:] for r in decide.alert_report(spark.createDataFrame(rows, "horizon int, month string, y_true int, y_mask int, y_prob double, thr double"), ["horizon"], "month").collect()}
    for h in (1, 3):
        for m in ("m1", "m2"):
            mine = [r for r in rows if r[:2] == (h, m)]
            hit = [r for r in mine if r[5] is not None and r[4] >= r[5]]
            assert got[(h, m)] == (mine[0][5], len(mine), sum(r[3] for r in mine), sum(r[2] * r[3] for r in mine), len(hit), sum(r[2] * r[3] for r in hit))


def test_alerts_of_the_flow_by_hand(spark):
    """Thresholds from calibrated validation rows and the alerts among the test rows, from collected scores."""
    from almanac.plans import splitting

    test, thr = splitting.calibrated(spark, "/root/testdata/sf0.001")
    rows, cut = test.collect(), {r["horizon"]: r["thr"] for r in thr.collect()}
    found = decide.alert_report(test.join(thr.select("horizon", "thr"), "horizon", "left"), ["horizon"], "month").collect()
    assert rows and len(found) == len({(r["horizon"], r["month"]) for r in rows})
    for f in found:
        mine = [r for r in rows if (r["horizon"], r["month"]) == (f["horizon"], f["month"])]
        assert (f["thr"], f["n"], f["alerts"]) == (cut.get(f["horizon"]), len(mine), sum(r["y_prob"] >= cut.get(f["horizon"], 2) for r in mine))


def test_archive_files_are_in_order(spark):
    from almanac.sources.tables import lay_out

    path = new_path(spark, "archive")
    lay_out(spark.range(1000).selectExpr("(id * 7919) % 1000 as t"), "t", path, 5)
    got = spark.read.parquet(path).select("t", "_metadata.file_path", F.unix_millis("_metadata.file_modification_time").alias("at")).toPandas()
    ends = got.groupby("at")["t"].agg(["min", "max"]).sort_index()
    assert len(ends) == got["file_path"].nunique() > 3 and (ends["min"].to_numpy()[1:] > ends["max"].to_numpy()[:-1]).all()
