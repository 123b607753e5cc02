"""Temporal splits, guardrails and sampling (G, D8, D9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import cube as cb, decide, joins as jn, metrics as mt, splits as sp, surge
from ..operators.patterns import only_row
from ..session import materialise
from . import base as b
from .alignment import annual_wide, samples
from .evaluation import BC, MET, budget_sql, four, metrics_sql
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


def labelled(spark, d, horizons=(1, 3)):
    """Long samples: entity, t_end, month, horizon, y, m."""
    lab = materialise(b.onset_labels(spark, d, (1.0,), horizons), "labels")
    return lab.where("t >= 12").select("entity", F.col("t").alias("t_end"), "month", "horizon", "y", "m")


LAB = "WITH RECURSIVE " + b.onset_labels_sql() + ", lab AS (SELECT entity, t AS t_end, month, horizon, y, m FROM labels_h WHERE t >= 12)"
NEXT = LAB + """,
c AS (SELECT min(CASE WHEN year(month) BETWEEN 1996 AND 1999 THEN t END) AS lo, max(CASE WHEN year(month) BETWEEN 1996 AND 1999 THEN t END) AS hi,
             min(CASE WHEN year(month) = 2000 THEN t END) AS tlo, max(CASE WHEN year(month) = 2000 THEN t END) AS thi FROM panel),
sp AS (SELECT l.*, 'train' AS split FROM lab l, c WHERE t_end BETWEEN lo AND hi - 3
       UNION ALL SELECT l.*, 'val' FROM lab l, c WHERE t_end BETWEEN hi - 3 - 5 AND hi - 3 AND t_end >= lo
       UNION ALL SELECT l.*, 'test' FROM lab l, c WHERE t_end BETWEEN tlo AND thi)"""


def next_year(spark, d):
    return sp.split_next_year(labelled(spark, d), b.panel(spark, d), 1996, 1999, 6, 3)


@query("g01_split_by_year", "WITH " + b.PANEL + """ SELECT CASE WHEN year(month) = 2000 THEN 'val' WHEN year(month) = 2001 THEN 'test' ELSE 'train' END AS split,
  count(*) AS n, min(month) AS lo, max(month) AS hi FROM panel GROUP BY 1""")
def _(spark, d):
    p = b.panel(spark, d).withColumn("split", sp.split_by_year("month", 2000, (2000, 2001)))
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("lo"), F.max("month").alias("hi"))


@query("g02_split_blocks", "WITH " + b.PANEL + " SELECT entity, t, CASE WHEN t % 18 < 6 THEN 'val' WHEN t % 18 < 12 THEN 'test' ELSE 'train' END AS split FROM panel")
def _(spark, d):
    return b.panel(spark, d).select("entity", "t", sp.split_blocks("t", 6).alias("split"))


@query("g03_split_next_year", NEXT + " SELECT entity, t_end, horizon, split FROM sp")
def _(spark, d):
    return next_year(spark, d).select("entity", "t_end", "horizon", "split")


@query("g04_split_fixed", LAB + " SELECT entity, t_end, horizon, CASE WHEN t_end % 18 < 6 THEN 'val' WHEN t_end % 18 < 12 THEN 'test' ELSE 'train' END AS split FROM lab")
def _(spark, d):
    stored = b.panel(spark, d).select("t").distinct().withColumn("split", sp.split_blocks("t", 6))
    return sp.split_fixed(labelled(spark, d), stored).select("entity", "t_end", "horizon", "split")


@query("g05_walk_forward", LAB + """,
o AS (SELECT unnest(generate_series(60, (SELECT max(t) FROM panel), 6)) AS origin),
r AS (SELECT origin, 'train' AS role, l.* FROM lab l, o WHERE t_end + 3 <= origin AND t_end >= origin - 36 + 1
      UNION ALL SELECT origin, 'val', l.* FROM lab l, o WHERE t_end + 3 <= origin AND t_end >= origin - 12 + 1
      UNION ALL SELECT origin, 'score', l.* FROM lab l, o WHERE t_end = origin)
SELECT CAST(origin AS INTEGER) AS origin, role, horizon, count(*) AS n, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS pos FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    top = only_row(b.panel(spark, d), F.max("t").alias("t"))
    s = labelled(spark, d).withColumn("_top", top)
    wf = sp.walk_forward(s, F.col("_top.t"), 3, F.lit(60), stride=6, window=36, val_window=12)
    return wf.groupBy("origin", "role", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").cast("bigint").alias("valid"), F.sum(F.col("y") * F.col("m")).cast("bigint").alias("pos"))


@query("h11_metrics_by_origin", LAB + """,
o AS (SELECT unnest(generate_series(40, (SELECT max(t) FROM panel), 6)) AS origin),
past AS (SELECT origin, entity, horizon, avg(y) AS y_prob FROM lab, o WHERE t_end + 3 <= origin GROUP BY 1, 2, 3),
v AS (SELECT p.origin, p.entity, p.horizon, y AS y_true, y_prob FROM lab l JOIN past p ON p.entity = l.entity AND p.horizon = l.horizon AND l.t_end = p.origin WHERE m = 1)"""
       + metrics_sql(["origin", "horizon"]) + budget_sql(["origin", "horizon"], [0.1])
       + f""" SELECT CAST(met.origin AS INTEGER) AS origin, met.horizon, n, pos, {MET}, {BC} FROM met JOIN bc ON bc.origin = met.origin AND bc.horizon = met.horizon""")
def _(spark, d):
    """Scores at each walk-forward origin: an entity's own event rate in the months before it."""
    lab = labelled(spark, d)
    top = only_row(b.panel(spark, d), F.max("t").alias("t"))
    wf = sp.walk_forward(lab.withColumn("_top", top), F.col("_top.t"), 3, F.lit(40), stride=6)
    past = wf.where("role = 'train'").groupBy("origin", "entity", "horizon").agg(F.avg("y").alias("y_prob"))
    now = wf.where("role = 'score'").select("origin", "entity", "horizon", F.col("y").alias("y_true"), F.col("m").alias("y_mask"))
    p = materialise(now.join(past, ["origin", "entity", "horizon"]), "origin_scores")
    keys = ["origin", "horizon"]
    out = four(mt.metric_table(p, keys)).join(mt.budget_metrics(p, keys, 0.1), keys)
    return out.withColumns({c: R(c) for c in ("thr", "hit", "fa_per_100")})


@query("g06_mask_policy", LAB + """ SELECT entity, t_end FROM lab GROUP BY 1, 2 HAVING min(m) = 1""")
def _(spark, d):
    lab = labelled(spark, d)
    return sp.mask_policy(lab.select("entity", "t_end").distinct(), lab, ["entity", "t_end"], "all")


@query("g06_mask_policy_any", LAB + """ SELECT entity, t_end FROM lab GROUP BY 1, 2 HAVING max(m) = 1""")
def _(spark, d):
    lab = labelled(spark, d)
    return sp.mask_policy(lab.select("entity", "t_end").distinct(), lab, ["entity", "t_end"], "any")


@query("g07_dedup", LAB + " SELECT DISTINCT CAST(t_end - 12 AS INTEGER) AS win_idx, entity FROM lab")
def _(spark, d):
    return sp.dedup(samples(spark, d).select("win_idx", "entity"), ["win_idx", "entity"])


@query("g08_choose_horizon", NEXT + """, c2 AS (SELECT horizon, CAST(sum(y * m) AS BIGINT) AS pos FROM sp WHERE split = 'train' GROUP BY 1)
SELECT horizon, pos FROM c2 ORDER BY pos DESC, horizon LIMIT 1""")
def _(spark, d):
    return sp.choose_horizon(next_year(spark, d).where("split = 'train'")).withColumn("pos", F.col("pos").cast("bigint"))


@query("g09_guardrail", NEXT + """, g AS (SELECT entity FROM sp WHERE split = 'train' AND horizon = 3 GROUP BY 1 HAVING sum(y * m) >= 6)
SELECT entity, t_end, horizon FROM sp WHERE split = 'train' AND (entity IN (SELECT entity FROM g) OR NOT EXISTS (SELECT 1 FROM g))""")
def _(spark, d):
    tr = next_year(spark, d).where("split = 'train'")
    return sp.guardrail(tr, "entity", 3, 6).select("entity", "t_end", "horizon")


@query("g10_class_weights", NEXT + """, tr AS (SELECT * FROM sp WHERE split = 'train' AND horizon = 3),
c3 AS (SELECT sum(CAST(m = 1 AND y = 1 AS INTEGER)) AS p, sum(CAST(m = 1 AND y = 0 AS INTEGER)) AS n FROM tr)
SELECT entity, t_end, round(CASE WHEN y = 1 THEN n::DOUBLE / greatest(p, 1) ELSE 1 END, 6) AS w FROM tr, c3""")
def _(spark, d):
    tr = next_year(spark, d).where("split = 'train' AND horizon = 3")
    return sp.class_weights(tr).select("entity", "t_end", R("w").alias("w"))


@query("g11_weighted_sample", """WITH w AS (SELECT o_orderkey AS k, o_totalprice AS w, sum(o_totalprice) OVER (ORDER BY o_orderkey) - o_totalprice AS lo FROM orders WHERE o_totalprice > 0),
t AS (SELECT sum(w) AS w FROM w),
d AS (SELECT CAST('0x' || substr(md5('7:' || o_orderkey), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE * t.w AS x FROM orders, t)
SELECT k AS o_orderkey, any_value(w.w) AS o_totalprice, count(*) AS draws FROM d ASOF JOIN w ON d.x >= w.lo GROUP BY 1""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sp.weighted_sample(o, "o_totalprice", "o_orderkey", seed=7)


@query("g12_sample_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def _(spark, d):
    return sp.sample_k(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, seed=7)


@query("g13_preflight_policy", LAB + """,
y AS (SELECT unnest([1997, 1998, 1999, 2000]) AS end_year),
b AS (SELECT end_year, max(t) AS hi FROM y JOIN panel ON year(month) BETWEEN 1996 AND end_year GROUP BY 1),
k AS (SELECT b.end_year, horizon, sum(CASE WHEN t_end >= 12 AND t_end <= hi - 3 THEN y * m ELSE 0 END) AS tp, sum(CASE WHEN t_end <= hi - 3 AND t_end > hi - 3 - 12 THEN y * m ELSE 0 END) AS vp
      FROM lab, b GROUP BY 1, 2),
p AS (SELECT end_year, CAST(sum(tp) AS BIGINT) AS train_pos, CAST(max(vp) AS BIGINT) AS val_pos_max FROM k GROUP BY 1)
SELECT CAST(end_year AS INTEGER) AS end_year, train_pos, val_pos_max, CASE WHEN end_year <= 1998 THEN 'any' ELSE 'all' END AS mask_policy,
  CASE WHEN end_year <= 1998 THEN 'auto' ELSE 'fixed' END AS sampler, CASE WHEN end_year <= 1998 AND train_pos = 0 THEN 0 WHEN end_year <= 1998 THEN 1 ELSE 2 END AS min_k,
  CASE WHEN end_year <= 1998 AND (train_pos = 0 OR val_pos_max < 5) THEN 'none' ELSE 'platt' END AS calibration FROM p""")
def _(spark, d):
    years = F.array(*map(F.lit, (1997, 1998, 1999, 2000)))
    hi = b.panel(spark, d).withColumn("end_year", F.explode(F.filter(years, lambda y: (F.year("month") <= y) & (F.year("month") >= 1996))))
    hi = hi.groupBy("end_year").agg(F.max("t").alias("hi"))
    lab = labelled(spark, d).withColumn("end_year", F.explode(years)).join(hi, "end_year")
    pos, cut = F.col("y") * F.col("m"), F.col("hi") - 3
    k = lab.groupBy("end_year", "horizon").agg(
        F.sum(F.when(F.col("t_end") <= cut, pos).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("t_end") <= cut) & (F.col("t_end") > cut - 12), pos).otherwise(0)).alias("vp"))
    p = k.groupBy("end_year").agg(F.sum("tp").cast("bigint").alias("train_pos"), F.max("vp").cast("bigint").alias("val_pos_max"))
    return sp.preflight_policy(p, 1998)


@query("g14_lodo_splits", """SELECT h.held_out, CASE WHEN lang = h.held_out THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM documents, (VALUES ('en'), ('fr'), ('de'), ('es')) h(held_out) GROUP BY 1, 2""")
def _(spark, d):
    out = sp.lodo_splits(load(spark, d, "documents").select("lang"), "lang", ["en", "fr", "de", "es"])
    return out.groupBy("held_out", "split").agg(F.count(F.lit(1)).alias("n"))


@query("g15_leak_check", NEXT + """ SELECT count(*) AS shared FROM (SELECT DISTINCT entity, t_end FROM sp WHERE split = 'train' INTERSECT SELECT DISTINCT entity, t_end FROM sp WHERE split = 'val')""")
def _(spark, d):
    s = next_year(spark, d)
    return sp.leak_check(s.where("split = 'train'"), s.where("split = 'val'"), ["entity", "t_end"])


@query("g16_run_grid", LAB.replace("(1.0::DOUBLE)", "(1.0::DOUBLE), (1.8::DOUBLE)").replace("SELECT entity, t AS t_end, month, horizon, y, m", "SELECT thr, entity, t AS t_end, month, horizon, y, m") + """,
g AS (SELECT thr, policy, cal FROM (VALUES (1.0::DOUBLE), (1.8::DOUBLE)) a(thr), (VALUES ('all'), ('any')) b(policy), (VALUES ('none'), ('platt')) c(cal)),
s AS (SELECT thr, entity, t_end, min(m) AS mn, max(m) AS mx, max(y) AS y FROM lab GROUP BY 1, 2, 3)
SELECT g.thr, policy AS mask_policy, cal AS calibration, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos
FROM g JOIN s ON s.thr = g.thr AND CASE WHEN policy = 'all' THEN mn ELSE mx END = 1 GROUP BY 1, 2, 3""")
def _(spark, d):
    grid = sp.run_grid(spark, thr=[1.0, 1.8], mask_policy=["all", "any"], calibration=["none", "platt"])
    lab = b.onset_labels(spark, d, (1.0, 1.8)).where("t >= 12").groupBy("thr", "entity", "t").agg(F.min("m").alias("mn"), F.max("m").alias("mx"), F.max("y").alias("y"))
    j = lab.join(grid, "thr").where(F.when(F.col("mask_policy") == "all", F.col("mn")).otherwise(F.col("mx")) == 1)
    return j.groupBy("thr", "mask_policy", "calibration").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))


@query("d08_split_summary", NEXT + """ SELECT split, sum(CAST(horizon = 1 AS BIGINT))::BIGINT AS n, sum(CASE WHEN horizon = 1 THEN m END)::BIGINT AS valid_h1, sum(CASE WHEN horizon = 1 THEN y * m END)::BIGINT AS pos_h1,
  sum(CASE WHEN horizon = 3 THEN m END)::BIGINT AS valid_h3, sum(CASE WHEN horizon = 3 THEN y * m END)::BIGINT AS pos_h3 FROM sp GROUP BY 1""")
def _(spark, d):
    return sp.split_summary(next_year(spark, d), [1, 3])


@query("d09_positive_counts", LAB + " SELECT entity, horizon, sum(m)::BIGINT AS valid, sum(y * m)::BIGINT AS pos FROM lab GROUP BY 1, 2")
def _(spark, d):
    return sp.pos_counts(labelled(spark, d), ["entity", "horizon"])


@query("d06_label_stats", LAB + """ SELECT horizon, CAST(year(month) AS INTEGER) AS year, sum(m)::BIGINT AS valid, sum(y * m)::BIGINT AS positives, round(sum(y * m) / greatest(sum(m), 1)::DOUBLE, 6) AS pos_rate FROM lab GROUP BY 1, 2""")
def _(spark, d):
    out = surge.label_stats(labelled(spark, d).withColumn("year", F.year("month")), ["horizon", "year"])
    return out.withColumn("pos_rate", R("pos_rate"))


def surge_rows(spark, d):
    """Samples of the surge classifier by split: tile vector of the month, gated statics, month code, entity, row weight."""
    lab = next_year(spark, d)
    tiles = cb.tile_vector(cb.tile_mean(b.cells(spark, d), 64, 64, 32)).withColumn("dynamic", F.transform("vec", lambda x: F.log1p(x)))
    width = only_row(tiles, F.max(F.size("dynamic")).alias("n"))["n"]  # all vectors have one length
    stat = jn.replicate_annual(annual_wide(spark, d), lab, ["entity"])
    vals = F.array(*[sc.signed_log1p(c) for c in ("a", "n", "r")])
    miss = F.array(*[F.col(c).isNull().cast("double") for c in ("a", "n", "r")])
    rows = stat.join(tiles.select("month", "dynamic"), "month", "left").select(
        "entity", "t_end", "month", "horizon", "y", "m", "split", F.coalesce("dynamic", F.array_repeat(F.lit(0.0), F.coalesce(width, F.lit(1)))).alias("dynamic"), sc.gate(vals, miss, sc.month_enc("month")).alias("static"))
    return rows


def surge_predictions(spark, d, horizons=(1, 3)):
    """Scores of the validation and test rows in the prediction contract; each horizon's model saw valid training rows only."""
    rows = materialise(surge_rows(spark, d), "surge_rows")
    out = None
    for h in horizons:
        mine = rows.where(F.col("horizon") == h)
        fit = sp.class_weights(mine.where("split = 'train' AND m = 1"))
        _, scored = decide.fit_surge_model(fit, mine.where("split <> 'train'"), ["dynamic", "static"], "y", "w", "entity")
        part = scored.select("entity", "t_end", "month", "horizon", F.col("y").alias("y_true"), F.col("m").alias("y_mask"), "y_prob", "split")
        out = part if out is None else out.unionByName(part)
    return materialise(out, "surge_predictions")


@query("i15_surge_model")
def _(spark, d):
    return surge_predictions(spark, d)


def calibrated(spark, d):
    """Test rows with scores calibrated on the validation rows, and the validation rows' budget thresholds."""
    p = surge_predictions(spark, d)
    val, test = p.where("split = 'val'"), p.where("split = 'test'")
    cal = lambda df: decide.calibrate(val, df, "platt").withColumn("y_prob", F.col("y_cal")).drop("y_cal")
    return cal(test), mt.budget_thresholds(cal(val), ["horizon"], [0.1])


@query("i15_flow_by_entity")
def _(spark, d):
    return mt.metric_table(calibrated(spark, d)[0], ["horizon", "entity"])


@query("i15_flow_by_month")
def _(spark, d):
    return mt.metric_table(calibrated(spark, d)[0], ["horizon", "month"])


@query("i15_flow_counts", NEXT + """ SELECT horizon, month, CAST(count(*) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives
FROM sp WHERE split = 'test' GROUP BY 1, 2""")
def _(spark, d):
    """Rows, valid labels and onsets of the test months that alerts are raised for."""
    test = surge_predictions(spark, d).where("split = 'test'")
    return decide.alert_report(test.withColumn("thr", F.lit(0.5)), ["horizon"], "month").select("horizon", "month", "n", "valid", "positives")


@query("i15_flow_alerts")
def _(spark, d):
    """Thresholds of the validation rows, and the alerts they raise among the test rows, by horizon and month."""
    test, thr = calibrated(spark, d)
    j = test.join(thr.select("horizon", "thr"), "horizon", "left")
    return decide.alert_report(j, ["horizon"], "month")
