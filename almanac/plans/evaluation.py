"""Forecast evaluation, thresholds, calibration and alerts (H, I, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import decide, metrics as mt, surge, timeseries as ts
from . import base as b
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


def rounded(df, *names, n=6):
    return df.withColumns({c: R(c, n) for c in names})


EDGES = mt.bin_edges(10)
BIN = " + ".join(f"CAST(y_prob >= CAST('{e!r}' AS DOUBLE) AS INTEGER)" for e in EDGES[1:])


def valid_sql(entity=False):
    return "WITH RECURSIVE " + b.preds_sql(entity) + ", v AS (SELECT * FROM preds WHERE y_mask = 1)"


def ranked_sql(by, src="v", p="y_prob"):
    keys = ", ".join(by)
    return f""", sc AS (SELECT {keys}, {p} AS p, count(*) AS n, sum(y_true) AS pos FROM {src} GROUP BY {keys}, {p}),
rk AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER (PARTITION BY {keys}) AS tot_n, sum(pos) OVER (PARTITION BY {keys}) AS tot_pos,
       sum(n) OVER u AS at_n, sum(pos) OVER u AS at_pos FROM sc WINDOW w AS (PARTITION BY {keys} ORDER BY p), u AS (PARTITION BY {keys} ORDER BY p DESC))"""


AUROC = "CASE WHEN max(tot_pos) > 0 AND max(tot_n) > max(tot_pos) THEN sum(pos * (cum_n - cum_pos - (n - pos) + 0.5::DOUBLE * (n - pos))) / (max(tot_pos)::DOUBLE * (max(tot_n) - max(tot_pos))) END"
AUPRC = "CASE WHEN max(tot_pos) > 0 THEN sum(pos * (at_pos::DOUBLE / at_n)) / max(tot_pos) END"


def metrics_sql(by, src="v"):
    """CTE ``met``: n, pos, auroc, auprc, brier, ece per group."""
    keys = ", ".join(by)
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM e.{k}" for k in by)
    on2 = " AND ".join(f"r.{k} IS NOT DISTINCT FROM z.{k}" for k in by)
    return ranked_sql(by, src) + f""",
rm AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, {AUROC} AS auroc, {AUPRC} AS auprc FROM rk GROUP BY {keys}),
eb AS (SELECT {keys}, {BIN} AS bin, sum(y_true - y_prob) AS gap FROM {src} GROUP BY {keys}, bin),
em AS (SELECT {keys}, sum(CASE WHEN bin < 10 THEN abs(gap) ELSE 0 END) AS g FROM eb GROUP BY {keys}),
bm AS (SELECT {keys}, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM {src} GROUP BY {keys}),
met AS (SELECT r.*, z.brier, e.g / r.n AS ece FROM rm r JOIN em e ON {on} JOIN bm z ON {on2})"""


MET = "round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(ece, 6) AS ece"
four = lambda df: rounded(df, "auroc", "auprc", "brier", "ece")


@query("h01_brier", valid_sql() + " SELECT year, horizon, round(avg((y_prob - y_true) * (y_prob - y_true)), 6) AS brier FROM v GROUP BY 1, 2")
def _(spark, d):
    return rounded(mt.brier(b.preds(spark, d), ["year", "horizon"]), "brier")


@query("h02_ece", valid_sql() + f""", eb AS (SELECT year, {BIN} AS bin, sum(y_true - y_prob) AS gap, count(*) AS n FROM v GROUP BY 1, 2)
SELECT year, round(sum(CASE WHEN bin < 10 THEN abs(gap) ELSE 0 END) / sum(n), 6) AS ece FROM eb GROUP BY 1""")
def _(spark, d):
    return rounded(mt.ece(b.preds(spark, d), ["year"]), "ece")


@query("h03_reliability", valid_sql() + f""" SELECT horizon, {BIN} AS bin, count(*) AS n, round(avg(y_prob), 6) AS mean_p, round(avg(y_true), 6) AS event_rate
FROM v GROUP BY 1, 2 HAVING bin < 10""")
def _(spark, d):
    return rounded(mt.reliability(b.preds(spark, d), ["horizon"]), "mean_p", "event_rate")


@query("h04_auroc", valid_sql(True) + ranked_sql(["year", "entity"]) + f" SELECT year, entity, round({AUROC}, 6) AS auroc FROM rk GROUP BY 1, 2")
def _(spark, d):
    return rounded(mt.auroc(b.preds(spark, d, True), ["year", "entity"]), "auroc")


@query("h04_auroc_documents", """WITH v AS (SELECT lang, quality AS y_true, n_chars::DOUBLE / (n_chars + 1000) AS y_prob FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
       + ranked_sql(["lang"]) + f" SELECT lang, round({AUROC}, 6) AS auroc FROM rk GROUP BY 1")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars")
    p = load(spark, d, "labels").join(docs, "doc_id").select(
        "lang", F.col("quality").alias("y_true"), F.lit(1).alias("y_mask"), (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("y_prob"))
    return rounded(mt.auroc(p, ["lang"]), "auroc")


@query("h05_auprc", valid_sql() + ranked_sql(["year"]) + f" SELECT year, round({AUPRC}, 6) AS auprc FROM rk GROUP BY 1")
def _(spark, d):
    return rounded(mt.auprc(b.preds(spark, d), ["year"]), "auprc")


@query("h06_roc_curve", valid_sql() + ranked_sql(["horizon"]) + """ SELECT horizon, round(p, 9) AS thr,
  round((at_n - at_pos)::DOUBLE / (tot_n - tot_pos), 9) AS fpr, round(at_pos::DOUBLE / tot_pos, 9) AS tpr FROM rk""")
def _(spark, d):
    return rounded(mt.roc_curve(b.preds(spark, d), ["horizon"]), "thr", "fpr", "tpr", n=9)


@query("h07_pr_curve", valid_sql() + ranked_sql(["horizon"]) + """ SELECT horizon, round(p, 9) AS thr, round(at_pos::DOUBLE / tot_pos, 9) AS recall,
  round(at_pos::DOUBLE / at_n, 9) AS "precision" FROM rk UNION ALL SELECT DISTINCT horizon, CAST(NULL AS DOUBLE), 0::DOUBLE, 1::DOUBLE FROM v""")
def _(spark, d):
    return rounded(mt.pr_curve(b.preds(spark, d), ["horizon"]), "thr", "recall", "precision", n=9)


@query("h08_metric_table", valid_sql() + metrics_sql(["horizon"]) + f" SELECT horizon, n, pos, {MET} FROM met")
def _(spark, d):
    return four(mt.metric_table(b.preds(spark, d), ["horizon"]))


@query("h09_metrics_by_month", valid_sql() + metrics_sql(["month", "horizon"]) + f" SELECT month, horizon, n, pos, {MET} FROM met")
def _(spark, d):
    return four(mt.metric_table(b.preds(spark, d), ["month", "horizon"]))


@query("h10_metrics_by_entity", valid_sql(True) + metrics_sql(["entity", "horizon"]) + f" SELECT entity, horizon, n, pos, {MET} FROM met")
def _(spark, d):
    return four(mt.metric_table(b.preds(spark, d, True), ["entity", "horizon"]))


CONF = """ SELECT year, CAST(sum(CAST(y_prob >= 0.5 AND y_true = 1 AS INTEGER)) AS BIGINT) AS tp, CAST(sum(CAST(y_prob >= 0.5 AND y_true = 0 AS INTEGER)) AS BIGINT) AS fp,
  CAST(sum(CAST(y_prob < 0.5 AND y_true = 1 AS INTEGER)) AS BIGINT) AS fn, CAST(sum(CAST(y_prob < 0.5 AND y_true = 0 AS INTEGER)) AS BIGINT) AS tn FROM v GROUP BY 1"""


@query("h12_confusion", valid_sql() + CONF)
def _(spark, d):
    return mt.confusion(b.preds(spark, d), ["year"], 0.5)


def budget_sql(by, budgets):
    keys = ", ".join(by)
    on = " AND ".join(f"v.{k} = t.{k}" for k in by)
    tk = ", ".join(f"t.{k}" for k in by)
    thr = " UNION ALL ".join(f"SELECT {keys}, {x}::DOUBLE AS budget, quantile_cont(y_prob, {1 - x!r}) AS thr FROM v GROUP BY {keys}" for x in budgets)
    return f""", bt AS ({thr}),
bc AS (SELECT {tk}, budget, thr, sum(CAST(y_prob >= thr AND y_true = 1 AS INTEGER))::DOUBLE / greatest(sum(y_true), 1) AS hit,
         sum(CAST(y_prob >= thr AND y_true = 0 AS INTEGER)) / (count(*) / 100.0::DOUBLE) AS fa_per_100
       FROM v JOIN bt t ON {on} GROUP BY {tk}, budget, thr)"""


BC = "round(thr, 6) AS thr, round(hit, 6) AS hit, round(fa_per_100, 6) AS fa_per_100"


@query("h13_budget_metrics", valid_sql() + budget_sql(["year", "horizon"], [0.1]) + f" SELECT year, horizon, {BC} FROM bc")
def _(spark, d):
    return rounded(mt.budget_metrics(b.preds(spark, d), ["year", "horizon"], 0.1), "thr", "hit", "fa_per_100")


BUDGETS = (0.01, 0.05, 0.1, 0.2, 0.3)


@query("h14_budget_curve", valid_sql() + budget_sql(["horizon"], BUDGETS) + f" SELECT horizon, budget, {BC} FROM bc")
def _(spark, d):
    return rounded(mt.budget_curve(b.preds(spark, d), ["horizon"], BUDGETS), "thr", "hit", "fa_per_100")


@query("h15_generalisation_gap", valid_sql() + metrics_sql(["split", "horizon"]) + """ SELECT horizon,
  round(max(CASE WHEN split = 'test' THEN auroc END) - max(CASE WHEN split = 'val' THEN auroc END), 6) AS gap_auroc,
  round(max(CASE WHEN split = 'test' THEN brier END) - max(CASE WHEN split = 'val' THEN brier END), 6) AS gap_brier FROM met GROUP BY 1""")
def _(spark, d):
    m = mt.metric_table(b.preds(spark, d), ["split", "horizon"])
    return rounded(mt.gen_gap(m, ["horizon"], ["auroc", "brier"]), "gap_auroc", "gap_brier")


@query("h16_auprc_uplift", valid_sql() + metrics_sql(["year"]) + " SELECT year, n, pos, round(auprc, 6) AS auprc, round(auprc / (pos::DOUBLE / n), 6) AS uplift FROM met")
def _(spark, d):
    m = mt.uplift(mt.metric_table(b.preds(spark, d), ["year"]))
    return rounded(m, "auprc", "uplift").select("year", "n", "pos", "auprc", "uplift")


@query("h17_brier_decomposition", valid_sql() + f""", rl AS (SELECT horizon, least({BIN}, 9) AS bin, count(*) AS n, avg(y_prob) AS mp, avg(y_true) AS er FROM v GROUP BY 1, 2),
bs AS (SELECT horizon, avg(y_true) AS base FROM v GROUP BY 1)
SELECT r.horizon, round(sum(n * (mp - er) ** 2) / sum(n), 6) AS reliability, round(sum(n * (er - base) ** 2) / sum(n), 6) AS resolution,
  round(max(base * (1 - base)), 6) AS uncertainty FROM rl r JOIN bs ON bs.horizon = r.horizon GROUP BY 1""")
def _(spark, d):
    return rounded(mt.brier_decomp(b.preds(spark, d), ["horizon"]), "reliability", "resolution", "uncertainty")


@query("h18_horizon_delta", valid_sql() + metrics_sql(["year", "horizon"]) + """ SELECT year,
  round(max(CASE WHEN horizon = 5 THEN auroc END) - max(CASE WHEN horizon = 3 THEN auroc END), 6) AS d5_3,
  round(max(CASE WHEN horizon = 3 THEN auroc END) - max(CASE WHEN horizon = 1 THEN auroc END), 6) AS d3_1 FROM met GROUP BY 1""")
def _(spark, d):
    m = mt.metric_table(b.preds(spark, d), ["year", "horizon"])
    return rounded(mt.horizon_delta(m, ["year"], "auroc"), "d5_3", "d3_1")


def two_configs(spark, d):
    """Both scores of a row as two configurations."""
    p = b.preds(spark, d)
    pair = F.explode(F.array(F.struct(F.lit("a").alias("config"), F.col("y_prob").alias("p")),
                             F.struct(F.lit("b").alias("config"), F.col("y_prob_b").alias("p"))))
    return p.withColumn("_c", pair).withColumn("config", F.col("_c.config")).withColumn("y_prob", F.col("_c.p")).drop("_c", "y_prob_b")


TWO = valid_sql() + """, v2 AS (SELECT year, horizon, 'a' AS config, y_true, y_prob FROM v UNION ALL SELECT year, horizon, 'b', y_true, y_prob_b FROM v)"""


@query("h19_ablation_best", TWO + metrics_sql(["config", "year"], "v2") + """ SELECT year, arg_max(config, auroc) AS best, round(max(auroc), 6) AS best_value,
  round(max(auroc) - min(auroc), 6) AS spread, count(*) AS configs FROM met GROUP BY 1""")
def _(spark, d):
    m = mt.metric_table(two_configs(spark, d), ["config", "year"])
    return rounded(mt.ablation_table(m, ["year"], "config", "auroc"), "best_value", "spread")


@query("h20_monthly_dispersion", valid_sql() + metrics_sql(["month", "horizon"]) + """ SELECT horizon, count(*) AS periods,
  CAST(sum(CAST(pos = 0 AS INTEGER)) AS BIGINT) AS zero_pos, round(quantile_cont(brier, 0.5), 6) AS median, round(quantile_cont(brier, 0.75) - quantile_cont(brier, 0.25), 6) AS iqr
  FROM met GROUP BY 1""")
def _(spark, d):
    m = mt.metric_table(b.preds(spark, d), ["month", "horizon"])
    return rounded(mt.dispersion(m, ["horizon"], "brier"), "median", "iqr")


@query("h21_bootstrap_ci")
def _(spark, d):
    return mt.bootstrap_ci(b.preds(spark, d), ["horizon"])


@query("h22_best_epoch", "WITH " + b.PANEL + """,
u AS (SELECT entity, t, price, coalesce(price >= max(price) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM panel),
l AS (SELECT *, last_value(CASE WHEN up THEN t END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS lt FROM u),
s AS (SELECT *, min(CASE WHEN t - lt >= 12 THEN t END) OVER (PARTITION BY entity) AS stop FROM l)
SELECT entity, max(lt) AS best_epoch, max(t) AS stopped_at, round(arg_max(price, t) FILTER (up), 6) AS best_score FROM s WHERE stop IS NULL OR t <= stop GROUP BY 1""")
def _(spark, d):
    return rounded(mt.best_epoch(b.panel(spark, d), ["entity"], "t", "price", 12), "best_score")


@query("h23_verify_tables", "WITH RECURSIVE " + b.onset_labels_sql() + """ SELECT horizon, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives,
  1 AS valid_ok, 1 AS positives_ok, 1 AS rate_ok FROM labels_h GROUP BY 1""")
def _(spark, d):
    lab = b.onset_labels(spark, d).withColumn("year", F.year("month"))
    return mt.verify_tables(surge.label_stats(lab, ["horizon", "year"]), surge.label_stats(lab, ["horizon"]), ["horizon"])


@query("h23_verify_broken_table", "WITH RECURSIVE " + b.onset_labels_sql() + """, k AS (SELECT horizon, CAST(sum(m) AS BIGINT) AS v, CAST(sum(y * m) AS BIGINT) AS p FROM labels_h GROUP BY 1),
t AS (SELECT horizon, v, p, v + CAST(horizon = 1 AS BIGINT) * (v % 7) AS valid, p + CAST(horizon = 3 AS BIGINT) * (p % 5) AS positives FROM k)
SELECT horizon, valid, positives, CAST(valid = v AS INTEGER) AS valid_ok, CAST(positives = p AS INTEGER) AS positives_ok, CAST(abs(positives / greatest(valid, 1)::DOUBLE - p / greatest(v, 1)::DOUBLE) <= 1e-9 AS INTEGER) AS rate_ok FROM t""")
def _(spark, d):
    """A published table with errors that follow from its own numbers: which of them are found."""
    lab = b.onset_labels(spark, d).withColumn("year", F.year("month"))
    t = surge.label_stats(lab, ["horizon"])
    t = t.withColumns({"valid": F.col("valid") + F.when(F.col("horizon") == 1, F.col("valid") % 7).otherwise(0), "positives": F.col("positives") + F.when(F.col("horizon") == 3, F.col("positives") % 5).otherwise(0)})
    t = t.withColumn("pos_rate", F.col("positives") / F.greatest("valid", F.lit(1)))
    return mt.verify_tables(surge.label_stats(lab, ["horizon", "year"]), t, ["horizon"])


NAIVE = "WITH " + b.PANEL + ", f AS (SELECT entity, t, price, lag(price, 1) OVER w AS fc, lag(price, 12) OVER w AS nv FROM panel WINDOW w AS (PARTITION BY entity ORDER BY t))"


def naive(spark, d):
    p = b.panel(spark, d)
    return p.withColumns({"fc": ts.seasonal_naive("price", 1, "entity", "t"), "nv": ts.seasonal_naive("price", 12, "entity", "t")})


@query("h24_mase_rmsse", NAIVE + """ SELECT entity, round(avg(abs(price - fc)) / avg(abs(price - nv)), 6) AS mase,
  round(sqrt(avg((price - fc) ** 2) / avg((price - nv) ** 2)), 6) AS rmsse FROM f GROUP BY 1""")
def _(spark, d):
    return rounded(mt.scaled_errors(naive(spark, d), ["entity"], "price", "fc", "nv"), "mase", "rmsse")


def _pin(tau):
    return f"greatest({tau}::DOUBLE * (price - fc * (0.5 + {tau}::DOUBLE)), ({tau}::DOUBLE - 1) * (price - fc * (0.5 + {tau}::DOUBLE)))"


@query("h25_pinball", NAIVE + " ".join(
    f"{'UNION ALL' if i else ''} SELECT {t}::DOUBLE AS tau, round(avg({_pin(t)}), 4) AS pinball, count({_pin(t)}) AS n FROM f" for i, t in enumerate((0.1, 0.5, 0.9))))
def _(spark, d):
    f = naive(spark, d).withColumn("tau", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    loss = sc.pinball("price", F.col("fc") * (F.col("tau") + 0.5), F.col("tau"))
    return f.groupBy("tau").agg(R(F.avg(loss), 4).alias("pinball"), F.count(loss).alias("n"))


@query("h26_interval_coverage", NAIVE + """ SELECT entity, round(avg(CAST(price BETWEEN fc * 0.8 AND fc * 1.2 AS INTEGER)), 6) AS coverage,
  round(avg(fc * 1.2 - fc * 0.8), 6) AS width, count(*) AS n FROM f WHERE fc IS NOT NULL GROUP BY 1""")
def _(spark, d):
    f = naive(spark, d).withColumns({"lo": F.col("fc") * 0.8, "hi": F.col("fc") * 1.2})
    return rounded(mt.coverage(f, ["entity"], "price", "lo", "hi"), "coverage", "width")


def _response(k):
    return f"SELECT {k} AS thr, y_prob, CAST(o_totalprice >= {k}000 AS INTEGER) AS y_true FROM vo"


@query("h27_threshold_response", "WITH vo AS (SELECT o_totalprice, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007 AS y_prob FROM orders WHERE o_orderstatus <> 'P'), v AS ("
       + " UNION ALL ".join(_response(k) for k in (200, 300, 400)) + ")" + metrics_sql(["thr"]) + f" SELECT thr, n, pos, {MET} FROM met")
def _(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        "o_totalprice", (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007).alias("y_prob"), F.lit(1).alias("y_mask"))
    o = o.withColumn("thr", F.explode(F.array(F.lit(200), F.lit(300), F.lit(400))))
    o = o.withColumn("y_true", (F.col("o_totalprice") >= F.col("thr") * 1000).cast("int"))
    return four(mt.metric_table(o, ["thr"]))


@query("h28_support_curve", valid_sql() + metrics_sql(["month", "horizon"]) + """ SELECT horizon, count(*) AS groups, round(corr(pos, auroc), 6) AS corr,
  round(regr_slope(auroc, pos), 6) AS slope, round(regr_intercept(auroc, pos), 6) AS intercept FROM met WHERE auroc IS NOT NULL GROUP BY 1""")
def _(spark, d):
    m = mt.metric_table(b.preds(spark, d), ["month", "horizon"])
    return rounded(mt.support_curve(m, ["horizon"]), "corr", "slope", "intercept")


# --- thresholds ------------------------------------------------------------------------------

QLIST = "[" + ", ".join(repr(x) for x in decide.CANDIDATES) + "]"


def sweep_sql(gain):
    return valid_sql() + f""", cand AS (SELECT DISTINCT horizon, unnest(quantile_cont(y_prob, {QLIST})) AS thr FROM v GROUP BY horizon),
tot AS (SELECT horizon, count(*) AS tot_n, sum(y_true) AS tot_pos FROM v GROUP BY 1),
sw AS (SELECT c.horizon, thr, count(*) AS at_n, sum(y_true) AS at_pos, max(tot_n) AS tot_n, max(tot_pos) AS tot_pos
       FROM cand c JOIN v ON v.horizon = c.horizon AND v.y_prob >= c.thr JOIN tot ON tot.horizon = c.horizon GROUP BY 1, 2),
g AS (SELECT *, {gain} AS gain FROM sw),
pk AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY gain DESC, thr) AS rn FROM g)
SELECT horizon, round(thr, 6) AS thr FROM pk WHERE rn = 1"""


@query("i01_threshold_f1", sweep_sql("2 * at_pos::DOUBLE / greatest(2 * at_pos + (at_n - at_pos) + (tot_pos - at_pos), 1)"))
def _(spark, d):
    return rounded(decide.thr_f1(b.preds(spark, d), ["horizon"]), "thr")


@query("i02_threshold_youden", sweep_sql("at_pos::DOUBLE / greatest(tot_pos, 1) - (at_n - at_pos)::DOUBLE / greatest(tot_n - tot_pos, 1)"))
def _(spark, d):
    return rounded(decide.thr_youden(b.preds(spark, d), ["horizon"]), "thr")


@query("i03_threshold_cost", sweep_sql("-(5.0 * (tot_pos - at_pos) + 1.0 * (at_n - at_pos))"))
def _(spark, d):
    return rounded(decide.thr_cost(b.preds(spark, d), ["horizon"]), "thr")


@query("i04_threshold_budget", valid_sql() + " SELECT horizon, split, round(quantile_cont(y_prob, 0.95), 6) AS thr FROM v GROUP BY 1, 2")
def _(spark, d):
    return rounded(decide.thr_budget(b.preds(spark, d), ["horizon", "split"], 0.05), "thr")


@query("i05_select_thresholds", valid_sql() + """, t AS (SELECT horizon, quantile_cont(y_prob, 0.9) AS thr FROM v WHERE split = 'val' GROUP BY 1)
SELECT p.horizon, round(coalesce(thr, 1.0), 6) AS thr FROM (SELECT DISTINCT horizon FROM preds WHERE split = 'val') p LEFT JOIN t ON t.horizon = p.horizon""")
def _(spark, d):
    p = b.preds(spark, d).where("split = 'val'")
    return rounded(decide.select_thresholds(p, ["horizon"], "budget", budget=0.1), "thr")


@query("i06_platt")
def _(spark, d):
    p = b.preds(spark, d)
    out = decide.calibrate(p.where("split = 'val'"), p.where("split = 'test'"), "platt", (1, 3, 5))
    return out.select("sample", "horizon", "y_prob", "y_cal")


@query("i06_platt_logit")
def _(spark, d):
    p = b.preds(spark, d)
    out = decide.calibrate(p.where("split = 'val'"), p.where("split = 'test'"), "platt", (1, 3, 5), link="logit")
    return out.select("sample", "horizon", "y_prob", "y_cal")


# The largest lower mean over starts of the smallest mean over ends is the monotone fit.
@query("i07_isotonic", valid_sql() + """, x AS (SELECT horizon, y_prob AS p, avg(y_true) AS y, count(*) AS w FROM v WHERE split = 'val' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY p) AS i, sum(w * y) OVER (PARTITION BY horizon ORDER BY p) AS cy, sum(w) OVER (PARTITION BY horizon ORDER BY p) AS cw FROM x),
ab AS (SELECT a.horizon, a.i AS ai, b.i AS bi, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) AS m FROM k a JOIN k b ON b.horizon = a.horizon AND b.i >= a.i),
mn AS (SELECT horizon, ai, bi, min(m) OVER (PARTITION BY horizon, ai ORDER BY bi DESC) AS m FROM ab),
iso AS (SELECT k.horizon, k.p, max(m) AS f FROM mn JOIN k ON k.horizon = mn.horizon AND k.i = mn.bi GROUP BY 1, 2),
t AS (SELECT sample, horizon, y_prob FROM preds WHERE split = 'test'),
lo AS (SELECT t.*, iso.p AS p0, iso.f AS f0 FROM t ASOF LEFT JOIN iso ON iso.horizon = t.horizon AND t.y_prob >= iso.p),
hi AS (SELECT lo.*, iso.p AS p1, iso.f AS f1 FROM lo ASOF LEFT JOIN iso ON iso.horizon = lo.horizon AND lo.y_prob <= iso.p)
SELECT sample, horizon, round(CASE WHEN p0 IS NULL THEN f1 WHEN p1 IS NULL OR p1 = p0 THEN f0 ELSE f0 + (f1 - f0) * (y_prob - p0) / (p1 - p0) END, 6) AS y_cal FROM hi""")
def _(spark, d):
    p = b.preds(spark, d)
    out = decide.calibrate(p.where("split = 'val'"), p.where("split = 'test'"), "isotonic", (1, 3, 5))
    return out.select("sample", "horizon", R("y_cal").alias("y_cal"))


@query("i08_identity", "WITH " + b.preds_sql() + " SELECT sample, round(y_prob, 9) AS y_cal FROM preds WHERE split = 'test'")
def _(spark, d):
    p = b.preds(spark, d)
    return decide.calibrate(p, p.where("split = 'test'"), "none", (1, 3, 5)).select("sample", R("y_cal", 9).alias("y_cal"))


@query("i09_calibrate_window")
def _(spark, d):
    p = b.preds(spark, d)
    fit = decide.calibration_window(p, F.lit("2000-12-01").cast("date"), 18)
    out = decide.calibrate(fit, p.where("split = 'test'"), "platt", (1, 3, 5)).withColumn("y_prob", F.col("y_cal"))
    return rounded(mt.ece(out, ["horizon"]), "ece")


FALL = ", ".join(f"CAST(sum(CASE WHEN month > DATE '2000-12-01' - INTERVAL {w} MONTH AND month <= DATE '2000-12-01' THEN y_true ELSE 0 END) AS BIGINT) AS pos_{w}" for w in (12, 18, 24))


@query("i10_calibration_fallback", valid_sql(True) + f""", c AS (SELECT entity, {FALL} FROM v GROUP BY 1),
w AS (SELECT *, CASE WHEN pos_12 >= 18 THEN 12 WHEN pos_18 >= 18 THEN 18 WHEN pos_24 >= 18 THEN 24 ELSE 0 END AS "window" FROM c)
SELECT *, CASE WHEN "window" > 0 THEN 'platt' ELSE 'none' END AS method FROM w""")
def _(spark, d):
    return decide.calib_fallback(b.preds(spark, d, True), ["entity"], F.lit("2000-12-01").cast("date"), min_pos=18)


@query("i11_alerts", valid_sql() + """, t AS (SELECT horizon, quantile_cont(y_prob, 0.9) AS thr FROM v WHERE split = 'val' GROUP BY 1)
SELECT year, p.horizon, count(*) AS n, CAST(sum(CAST(y_prob >= thr AS INTEGER)) AS BIGINT) AS alerts FROM preds p JOIN t ON t.horizon = p.horizon GROUP BY 1, 2""")
def _(spark, d):
    p = b.preds(spark, d)
    thr = decide.thr_budget(p.where("split = 'val'"), ["horizon"], 0.1)
    return decide.alerts(p, thr, ["horizon"]).groupBy("year", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("alert").alias("alerts"))


GRID = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
TEMP = " UNION ALL ".join(f"SELECT horizon, {t}::DOUBLE AS temperature, y_true, least(greatest(1 / (1 + exp(-ln(y_prob / (1 - y_prob)) / {t}::DOUBLE)), 1e-6), 1 - 1e-6) AS q FROM v" for t in GRID)


@query("i12_temperature", valid_sql() + f""", e AS ({TEMP}), nl AS (SELECT horizon, temperature, avg(-(y_true * ln(q) + (1 - y_true) * ln(1 - q))) AS nll FROM e GROUP BY 1, 2)
SELECT horizon, arg_min(temperature, nll) AS temperature, round(min(nll), 6) AS nll FROM nl GROUP BY 1""")
def _(spark, d):
    return rounded(decide.temperature_fit(b.preds(spark, d), ["horizon"], GRID), "nll")


@query("i13_conformal_bands", NAIVE + """, r AS (SELECT *, fc * 0.8 AS lo, fc * 1.2 AS hi FROM f WHERE fc IS NOT NULL),
a AS (SELECT entity, 0.1::DOUBLE AS alpha, quantile_cont(greatest(lo - price, price - hi), 0.9) AS adj FROM r WHERE t < 60 GROUP BY 1
      UNION ALL SELECT entity, 0.2::DOUBLE, quantile_cont(greatest(lo - price, price - hi), 0.8) FROM r WHERE t < 60 GROUP BY 1)
SELECT r.entity, alpha, round(avg(CAST(price BETWEEN lo - adj AND hi + adj AS INTEGER)), 6) AS coverage, round(avg((hi + adj) - (lo - adj)), 5) AS width, count(*) AS n
FROM r JOIN a ON a.entity = r.entity WHERE t >= 60 GROUP BY 1, 2""")
def _(spark, d):
    f = naive(spark, d).where("fc IS NOT NULL").withColumns({"lo": F.col("fc") * 0.8, "hi": F.col("fc") * 1.2})
    out = decide.cqr(f.where("t < 60"), f.where("t >= 60"), ["entity"], "price", "lo", "hi", [0.1, 0.2])
    out = mt.coverage(out, ["entity", "alpha"], "price", "lo_c", "hi_c")
    return out.withColumns({"coverage": R("coverage"), "width": R("width", 5)})


@query("i13_conformal_rolling", NAIVE + """, r AS (SELECT *, fc * 0.8 AS lo, fc * 1.2 AS hi FROM f),
q AS (SELECT *, quantile_cont(greatest(lo - price, price - hi), 0.9) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS adj FROM r)
SELECT entity, t, round(lo - adj + 1e-8, 5) AS lo_c, round(hi + adj + 1e-8, 5) AS hi_c FROM q""")
def _(spark, d):
    f = naive(spark, d).withColumns({"lo": F.col("fc") * 0.8, "hi": F.col("fc") * 1.2})
    out = decide.cqr_rolling(f, ["entity"], "t", "price", "lo", "hi", 0.1, 24)
    return out.select("entity", "t", R(F.col("lo_c") + 1e-8, 5).alias("lo_c"), R(F.col("hi_c") + 1e-8, 5).alias("hi_c"))


@query("i14_drift_alarm", valid_sql() + metrics_sql(["month", "horizon"]) + """, o AS (SELECT month, horizon, ece, CAST(ece > 0.3 AS INTEGER) AS over_limit FROM met)
SELECT month, horizon, round(ece, 6) AS ece, over_limit, CAST(over_limit = 1 AND coalesce(lag(over_limit) OVER (PARTITION BY horizon ORDER BY month), 0) = 1 AS INTEGER) AS recalibrate FROM o""")
def _(spark, d):
    m = mt.ece(b.preds(spark, d), ["month", "horizon"])
    return rounded(decide.drift_alarm(m, ["horizon"], "month", 0.3), "ece")


TRIAGE = valid_sql(True) + ", hist AS (SELECT * FROM v WHERE split <> 'test')" + ranked_sql(["entity"], "hist") + f""",
au AS (SELECT entity, {AUROC} AS auroc FROM rk GROUP BY 1),
la AS (SELECT entity, avg(y_prob) AS risk FROM preds WHERE split = 'test' GROUP BY 1)
SELECT la.entity, round(risk, 6) AS risk, round(auroc, 6) AS auroc FROM la JOIN au ON au.entity = la.entity WHERE auroc >= 0.5 ORDER BY la.risk DESC, la.entity LIMIT 5"""


@query("i16_triage", TRIAGE)
def _(spark, d):
    p = b.preds(spark, d, True)
    hist = mt.auroc(p.where("split <> 'test'"), ["entity"])
    latest = p.where("split = 'test'").groupBy("entity").agg(F.avg("y_prob").alias("risk"))
    return rounded(decide.triage(hist, latest, "entity", 0.5, 5), "risk", "auroc")


@query("i17_pareto", valid_sql() + budget_sql(["horizon"], BUDGETS) + f""", m AS (SELECT *, max(hit) OVER (PARTITION BY horizon ORDER BY fa_per_100, hit DESC, budget ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM bc)
SELECT horizon, budget, {BC} FROM m WHERE b IS NULL OR hit > b""")
def _(spark, d):
    c = mt.budget_curve(b.preds(spark, d), ["horizon"], BUDGETS)
    return rounded(decide.pareto(c, ["horizon"]), "thr", "hit", "fa_per_100")
