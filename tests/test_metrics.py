import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import decide, metrics as mt, pairs as pr, reliability as rl, splits as sp
from almanac.operators.components import components


def preds(spark, n=600, seed=5, digits=2):
    rng = np.random.default_rng(seed)
    p = rng.random(n).round(digits)
    pdf = pd.DataFrame({"sample": range(n), "g": rng.integers(0, 3, n), "y_true": (rng.random(n) < p * 0.7).astype(int), "y_mask": (rng.random(n) < 0.9).astype(int), "y_prob": p})
    return pdf, spark.createDataFrame(pdf)


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))


def ap(y, p):
    out = 0.0
    for t in np.unique(p):
        sel = p >= t
        out += (y[p == t].sum() / y.sum()) * (y[sel].sum() / sel.sum())
    return out


def test_metric_table_against_definitions(spark):
    pdf, df = preds(spark)
    got = mt.metric_table(df, ["g"]).toPandas().set_index("g")
    for g, x in pdf[pdf.y_mask == 1].groupby("g"):
        y, p = x["y_true"].values, x["y_prob"].values
        assert abs(got.loc[g, "auroc"] - auc(y, p)) < 1e-9 and abs(got.loc[g, "auprc"] - ap(y, p)) < 1e-9
        assert abs(got.loc[g, "brier"] - np.mean((p - y) ** 2)) < 1e-9
        idx = np.digitize(p, np.linspace(0, 1, 11)) - 1
        want = sum((idx == b).mean() * abs(y[idx == b].mean() - p[idx == b].mean()) for b in range(10) if (idx == b).any())
        assert abs(got.loc[g, "ece"] - want) < 1e-9
    one = mt.ece(df, ["g"]).toPandas().set_index("g")["ece"]
    assert np.allclose(one.sort_index(), got["ece"].sort_index())


def test_score_of_one_is_outside_every_bin(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.95)], "y_true int, y_mask int, y_prob double")
    assert abs(mt.ece(df, []).first()["ece"] - 0.05 / 2) < 1e-12
    assert abs(mt.ece(df, [], include_right=True).first()["ece"] - abs((0 - 1.0) + (1 - 0.95)) / 2) < 1e-12


def test_single_class_and_empty(spark):
    df = spark.createDataFrame([(0, 1, 0.3), (0, 1, 0.4)], "y_true int, y_mask int, y_prob double")
    r = mt.metric_table(df, []).first()
    assert r["auroc"] is None and r["auprc"] is None and r["n"] == 2
    assert mt.metric_table(df.withColumn("k", F.lit(1)).where("y_mask = 0"), ["k"]).count() == 0


def test_auroc_is_invariant_under_monotone_maps(spark):
    _, df = preds(spark)
    a = mt.auroc(df, []).first()[0]
    b = mt.auroc(df.withColumn("y_prob", F.pow("y_prob", F.lit(3.0))), []).first()[0]
    assert abs(a - b) < 1e-12


def brute_sweep(x, score):
    y, p = x["y_true"].values, x["y_prob"].values
    best, bt = -np.inf, 0.5
    for t in np.unique(np.quantile(p, np.linspace(0, 1, 200))):
        s = score(y, p >= t)
        if s > best + 1e-15:
            best, bt = s, t
    return bt


SCORES = {
    "f1": lambda y, a: 2 * (a & (y == 1)).sum() / max(2 * (a & (y == 1)).sum() + (a & (y == 0)).sum() + (~a & (y == 1)).sum(), 1),
    "youden": lambda y, a: (a & (y == 1)).sum() / max((y == 1).sum(), 1) - (a & (y == 0)).sum() / max((y == 0).sum(), 1),
    "cost": lambda y, a: -(5.0 * (~a & (y == 1)).sum() + (a & (y == 0)).sum()),
}


@pytest.mark.parametrize("policy", list(SCORES))
def test_threshold_policies_against_brute_force(spark, policy):
    pdf, df = preds(spark, digits=3)
    got = {r.g: r.thr for r in decide.select_thresholds(df, ["g"], policy).collect()}
    for g, x in pdf[pdf.y_mask == 1].groupby("g"):
        assert abs(got[g] - brute_sweep(x, SCORES[policy])) < 1e-9


def test_defaults_without_valid_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.4)], "g int, y_true int, y_mask int, y_prob double")
    assert decide.select_thresholds(df, ["g"], "budget").first()["thr"] == 1.0
    assert decide.select_thresholds(df, ["g"], "f1").first()["thr"] == 0.5


def test_budget_alert_share(spark):
    pdf, df = preds(spark, digits=6)
    r = mt.budget_metrics(df, [], 0.1).first()
    v = pdf[pdf.y_mask == 1]
    assert abs(r["thr"] - np.quantile(v["y_prob"], 0.9)) < 1e-9
    assert abs((v["y_prob"] >= r["thr"]).mean() - 0.1) < 0.01
    assert abs(r["hit"] - v[v["y_prob"] >= r["thr"]]["y_true"].sum() / v["y_true"].sum()) < 1e-12


def pav(p, y):
    blocks = []
    for v, w in sorted((q, (y[p == q].mean(), (p == q).sum())) for q in np.unique(p)):
        blocks.append([w[0], w[1], [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return {x: b[0] for b in blocks for x in b[2]}


def test_isotonic_matches_pooling(spark):
    pdf, df = preds(spark)
    v = pdf[pdf.y_mask == 1]
    want = pav(v["y_prob"].values, v["y_true"].values)
    cal = decide.Isotonic().fit(df)
    got = df.where("y_mask = 1").select("y_prob", cal.transform("y_prob").alias("c")).toPandas()
    assert np.allclose(got["c"], [want[p] for p in got["y_prob"]], atol=1e-9)
    ends = spark.createDataFrame([(-1.0,), (2.0,)], "y_prob double").select(cal.transform("y_prob").alias("c")).toPandas()["c"]
    assert ends[0] == min(want.values()) and ends[1] == max(want.values())


def test_isotonic_table_with_many_scores(spark):
    rng = np.random.default_rng(5)
    n = 100_000
    p = rng.random(n)
    pdf = pd.DataFrame({"horizon": rng.integers(0, 2, n), "y_prob": p, "y_true": (rng.random(n) < p**2).astype(int), "y_mask": 1})
    pdf.loc[pdf.index % 3 == 0, "y_prob"] = 0.25  # a third of all rows on one score
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(7, 0.5, 1, 1)], "horizon long, y_prob double, y_true long, y_mask long"))
    knots = decide.isotonic_knots(df, ["horizon"])
    got = decide.apply_knots(df, knots, ["horizon"]).toPandas()
    assert len(got) == n + 1 and got[got.horizon == 7]["y_cal"].tolist() == [0.5]
    for h, g in got[got.horizon < 2].groupby("horizon"):
        cells = g.groupby("y_prob")["y_true"].agg(["mean", "count"])
        blocks = []
        for m, c in zip(cells["mean"], cells["count"]):
            blocks.append([m, c, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        want = dict(zip(cells.index, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])))
        assert np.allclose(g["y_cal"], [want[x] for x in g["y_prob"]], atol=1e-9)
    with pytest.raises(Exception, match="no calibrator"):
        decide.calibrate(df, df, "isotonic", (0, 1)).collect()


def test_platt_solves_the_penalised_fit(spark):
    pdf, df = preds(spark)
    v = pdf[pdf.y_mask == 1]
    m = decide.Platt().fit(df).model
    w, b = float(m.coefficients[0]), float(m.intercept)
    x, y = np.clip(v["y_prob"].values, 1e-6, 1 - 1e-6), v["y_true"].values
    r = 1 / (1 + np.exp(-(w * x + b))) - y
    assert abs((r * x).sum() + w) < 0.05 and abs(r.sum()) < 0.05  # gradient of C = 1, free intercept


def test_small_or_one_sided_fits_pass_through(spark):
    df = spark.createDataFrame([(i % 2, 1, 0.1 * i) for i in range(8)], "y_true int, y_mask int, y_prob double")
    for cal in (decide.Platt(), decide.Isotonic(), decide.Identity()):
        got = df.select("y_prob", cal.fit(df).transform("y_prob").alias("c")).toPandas()
        assert (got["c"] == got["y_prob"]).all()


def test_risk_coverage_and_macro_f1(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.7, 0), (0.6, 1)], "conf double, err int")
    r = rl.aurc(df, "conf", "err").first()
    assert abs(r["aurc"] - np.mean([0, 1 / 2, 1 / 3, 2 / 4])) < 1e-12 and abs(r["augrc"] - np.mean([0, 1 / 4, 1 / 4, 2 / 4])) < 1e-12
    assert abs(rl.risk_at(df, "conf", "err", 0.7).first()["risk"] - 1 / 3) < 1e-12
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    m = rl.macro_f1(c, "t", "p").first()
    assert m["accuracy"] == 0.5 and abs(m["macro_f1"] - (2 * 1 / 4 + 2 * 1 / 3 + 0) / 3) < 1e-12


def test_mcnemar_tail():
    assert abs(rl.mcnemar_p(3.841458820694124) - 0.05) < 1e-9


def test_pairs_half_triangle_and_audit(spark):
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"entity": np.repeat(range(9), 5), "year": np.tile(range(2000, 2005), 9), "x": rng.random(45), "y": rng.random(45)})
    lab = pr.index_labels(spark.createDataFrame(pts))
    p = pr.pairwise_distance(lab, ["x", "y"], block=8)
    a = pr.matrix_audit(p).first()
    assert (a["total"], a["diag"], a["complete"]) == (45 * 46 // 2, 45, 1)
    assert a["total"] == a["diag"] + a["same_year"] + a["cross_year"] and a["diag_nonzero"] == a["label_mismatch"] == a["nan"] == 0
    got = p.toPandas()
    x = pts.sort_values(["entity", "year"])[["x", "y"]].values
    assert np.allclose(got["distance"], np.sqrt(((x[got["i_idx"]] - x[got["j_idx"]]) ** 2).sum(1)))
    r = pr.pair_lookup(p, (8, 2004), (0, 2000)).collect()
    assert len(r) == 1 and r[0]["i_idx"] == 0
    dirty = p.withColumn("distance", F.when(F.col("i_idx") == 0, F.lit(float("nan"))).when(F.col("i_idx") == 1, F.lit(float("-inf"))).otherwise(F.col("distance")))
    b = pr.matrix_audit(dirty).first()
    assert b["nan"] == 45 and b["inf"] == b["neg"] == 44


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = pr.pca2(df, ["a", "b", "c", "d"]).orderBy("id").select("pc1", "pc2").toPandas().values
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ vt[:2].T
    for j in range(2):
        assert np.allclose(np.abs(got[:, j]), np.abs(want[:, j]), atol=1e-6)


def test_components_of_odd_and_wide_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 60)) * np.linspace(3, 0.2, 60) + 1e5
    odd = [None, [], [1.0] * 59, [float("nan")] * 60, [None] + [1.0] * 59, [float("inf")] * 60]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x.tolist(), *odd])], "id int, v array<double>").repartition(5)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    whole = components(df, F.col("v"), None)
    assert whole.n == 120 and np.allclose(whole.variances, want, atol=1e-6) and np.allclose(whole.loadings.T @ whole.loadings, np.eye(60))
    wide = components(df, F.col("v"), 2, wide=10, extra=30, passes=8)
    assert np.allclose(wide.variances, want[:2], rtol=1e-3) and np.allclose(np.abs((wide.loadings * whole.loadings[:, :2]).sum(axis=0)), 1, atol=1e-2)
    got = pr.pca2(df, "v").orderBy("id").select("pc1", "pc2").collect()
    assert np.allclose([list(r) for r in got[:120]], (x - x.mean(axis=0)) @ whole.loadings[:, :2], atol=1e-6)
    assert all(r["pc1"] is None and r["pc2"] is None for r in got[120:])
    assert pr.pca2(df.where("id >= 120 and id <> 122"), "v").select("pc1", "pc2").distinct().collect() == [(None, None)]


def test_weighted_sample_counts(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "id bigint, w double")
    got = sp.weighted_sample(df, "w", "id", 20000, seed=3).toPandas()
    assert got["draws"].sum() == 20000 and (got["w"] > 0).all()
    share = got.groupby("w")["draws"].sum() / 20000
    assert np.allclose(share, np.array([1, 2, 3, 4]) / 10, atol=0.02)
    again = sp.weighted_sample(df, "w", "id", 20000, seed=3).toPandas()
    assert (got.set_index("id")["draws"].sort_index() == again.set_index("id")["draws"].sort_index()).all()


def test_bootstrap_interval_covers_the_estimate(spark):
    _, df = preds(spark, n=400)
    r = mt.bootstrap_ci(df, [], ["sample"], replicates=40, seed=1).first()
    a = mt.auroc(df, []).first()[0]
    assert r["replicates"] == 40 and r["auroc_lo"] < a < r["auroc_hi"] and r["auroc_hi"] - r["auroc_lo"] < 0.3


def test_temperature_grid(spark):
    _, df = preds(spark)
    losses = mt.observed(df)
    t = decide.temperature_fit(df, [], (0.5, 1.0, 2.0)).first()
    x = losses.toPandas()
    q = np.clip(x["y_prob"], 1e-6, 1 - 1e-6)
    def nll(T):
        s = np.clip(1 / (1 + np.exp(-np.log(q / (1 - q)) / T)), 1e-6, 1 - 1e-6)
        return float(np.mean(-(x["y_true"] * np.log(s) + (1 - x["y_true"]) * np.log(1 - s))))
    assert t["temperature"] == min((0.5, 1.0, 2.0), key=nll) and math.isclose(t["nll"], min(map(nll, (0.5, 1.0, 2.0))), rel_tol=1e-9)


def test_surge_model_learns_a_separable_signal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    rows = [(i % 5, [float(a), float(b)], float(a > 0), 1.0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "entity int, f array<double>, y double, w double")
    _, scored = decide.fit_surge_model(df.where("f[1] < 1"), df, ["f"], "y", "w", "entity")
    out = scored.select(F.col("y").alias("y_true"), F.lit(1).alias("y_mask"), "y_prob")
    assert out.count() == 300 and mt.auroc(out, []).first()[0] > 0.98


def test_propagation_brackets_the_sum(spark):
    from almanac.operators import multirate as mr

    df = spark.createDataFrame([("a", i, 8.0, 10.0, 12.0) for i in range(20)], "g string, t int, lo double, mid double, hi double")
    run = lambda: mr.propagate(df, ["g"], ["g", "t"], [(0.05, "lo"), (0.5, "mid"), (0.95, "hi")], 200, (0.05, 0.5, 0.95), seed=2).first()
    r = run()
    assert 160 < r["q05"] < r["q50"] < r["q95"] < 240 and abs(r["q50"] - 200) < 3 and r == run()


def test_cluster_bootstrap_weighs_whole_clusters(spark):
    _, df = preds(spark, n=300)
    r = rl.cluster_bootstrap(df, [], ["g"], replicates=400, seed=1).first()
    a, one = mt.auroc(df, []).first()[0], rl.cluster_bootstrap(df.withColumn("g", F.lit(0)), [], ["g"], replicates=400, seed=1).first()
    assert r["auroc_lo"] < a < r["auroc_hi"]
    # One cluster has one weight: every replicate that has rows at all repeats the estimate.
    assert one["auroc_lo"] == pytest.approx(a) == pytest.approx(one["auroc_hi"]) and 200 < one["replicates"] < 300


def test_poisson_draws_have_their_mean_and_variance():
    from almanac.operators.draws import poisson

    x = poisson(np.arange(4) * 7919 + 5, np.array([0, 1, 30, 700]), 20_000)
    assert (x[0] == 0).all()
    for row, mean in zip(x[1:], (1, 30, 700)):
        assert abs(row.mean() - mean) < 5 * (mean / 20_000) ** 0.5 and abs(row.var() / mean - 1) < 0.06


def test_replicates_agree_with_a_direct_computation(spark):
    from almanac.operators.draws import poisson

    rows = [(i, float(i % 7) / 10, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, int(y), 1, p) for i, p, y in rows], "sample long, y_true int, y_mask int, y_prob double")
    got = mt.bootstrap_ci(df, [], ["sample"], replicates=50, seed=3).first()
    keys = np.array([r[0] for r in df.orderBy("sample").select(F.xxhash64("sample", F.lit(3))).collect()])
    w = poisson(keys, np.ones(60), 50)
    p, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    order = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
    auc = [(a[y] @ order[np.ix_(y, ~y)] @ a[~y]) / (a[y].sum() * a[~y].sum()) for a in w.T]
    assert [got["auroc_lo"], got["auroc_mid"], got["auroc_hi"]] == pytest.approx(np.quantile(auc, [0.025, 0.5, 0.975]).tolist())
    loss = [(a * (p - y) ** 2).sum() / a.sum() for a in w.T]
    assert got["brier_mid"] == pytest.approx(np.quantile(loss, 0.5))


def test_budgets_beyond_the_edges_stay_apart(spark):
    _, df = preds(spark, n=50)
    assert sorted(r["budget"] for r in mt.budget_thresholds(df, [], [1.0, 1.5, 2.0, 0.1]).collect()) == [0.1, 1.0, 1.5, 2.0]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    from almanac.sources.tables import fingerprint

    _, df = preds(spark, n=200)
    a = fingerprint(df, "x").first()
    assert a == fingerprint(df.orderBy(F.desc("y_prob")).repartition(3), "x").first()
    assert a["fingerprint"] != fingerprint(df.withColumn("g", F.when(F.col("sample") == 0, 9).otherwise(F.col("g"))), "x").first()["fingerprint"]


def test_fixed_size_sample_and_sketch(spark):
    pdf, df = preds(spark, digits=6)
    s = sp.sample_k(df, ["sample"], 50, seed=2)
    assert s.count() == 50 and {r.sample for r in s.collect()} == {r.sample for r in sp.sample_k(df.repartition(5), ["sample"], 50, seed=2).collect()}
    from almanac.operators.patterns import quantiles

    got = {r.q: r.value for r in quantiles(df, [], "y_prob", [0.25, 0.5], exact=False).collect()}
    assert all(abs(got[q] - pdf["y_prob"].quantile(q)) < 0.01 for q in (0.25, 0.5))
