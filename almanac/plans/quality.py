"""Reliability and reports (L, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt, reliability as rl, reports as rp
from ..session import materialise
from . import base as b
from .evaluation import BC, MET, TWO, budget_sql, four, metrics_sql, ranked_sql, rounded, two_configs, valid_sql
from .registry import load, query
from .splitting import NEXT, next_year

R = lambda c, n=6: F.round(c, n)

RC = "WITH " + b.preds_sql() + ", v AS (SELECT year, greatest(y_prob_b, 1 - y_prob_b) AS y_prob, CAST(CAST(y_prob_b >= 0.5 AS INTEGER) <> y_true AS INTEGER) AS y_true FROM preds)" + ranked_sql(["year"])


def conf_rows(spark, d):
    p = b.preds(spark, d)
    q = F.col("y_prob_b")
    return p.select("year", "sample", F.greatest(q, 1 - q).alias("conf"), ((q >= 0.5).cast("int") != F.col("y_true")).cast("int").alias("err"))


@query("l01_risk_coverage", RC + " SELECT year, round(p, 9) AS conf, CAST(n AS BIGINT) AS n, round(at_n / tot_n, 9) AS coverage, round(at_pos / at_n, 9) AS risk, round(at_pos / tot_n, 9) AS generalised_risk FROM rk")
def _(spark, d):
    return rounded(rl.risk_coverage(conf_rows(spark, d), "conf", "err", ["year"]), "conf", "coverage", "risk", "generalised_risk", n=9)


@query("l02_aurc_augrc", RC + " SELECT year, round(sum(n * (at_pos / at_n)) / sum(n), 6) AS aurc, round(sum(n * (at_pos / tot_n)) / sum(n), 6) AS augrc FROM rk GROUP BY 1")
def _(spark, d):
    return rounded(rl.aurc(conf_rows(spark, d), "conf", "err", ["year"]), "aurc", "augrc")


@query("l03_risk_at_coverage", RC + " SELECT year, round(min(at_n / tot_n), 9) AS coverage, round(arg_min(at_pos / at_n, at_n / tot_n), 9) AS risk FROM rk WHERE at_n / tot_n >= 0.8 GROUP BY 1")
def _(spark, d):
    return rounded(rl.risk_at(conf_rows(spark, d), "conf", "err", 0.8, ["year"]), "coverage", "risk", n=9)


@query("l04_ece_equal_mass", valid_sql() + ranked_sql(["horizon"]) + """, g AS (SELECT horizon, least((cum_n - n) * 15 // tot_n, 14) AS bin, sum(n) AS n, sum(n * p) / sum(n) AS mp, sum(pos) / sum(n) AS er FROM rk GROUP BY 1, 2)
SELECT horizon, round(sum(n * abs(mp - er)) / sum(n), 6) AS ece_mass, round(sqrt(greatest(sum(n * ((mp - er) ** 2 - coalesce(er * (1 - er) / nullif(n - 1, 0), 0))) / sum(n), 0)), 6) AS debiased FROM g GROUP BY 1""")
def _(spark, d):
    return rounded(rl.ece_mass(b.preds(spark, d), ["horizon"]), "ece_mass", "debiased")


@query("l05_nll", valid_sql() + " SELECT year, round(avg(-(y_true * ln(y_prob) + (1 - y_true) * ln(1 - y_prob))), 6) AS nll FROM v GROUP BY 1")
def _(spark, d):
    return rounded(rl.nll(b.preds(spark, d), ["year"]), "nll")


PR = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRS = "[" + ", ".join(f"'{p}'" for p in PR) + "]"


@query("l06_macro_f1", f"""WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS t, {PRS}[CAST(o_orderkey % 7 % 5 + 1 AS INTEGER)] AS p FROM orders),
k AS (SELECT year, t AS cls, count(*) AS t, 0 AS p, sum(CAST(t = p AS INTEGER)) AS tp FROM c GROUP BY 1, 2 UNION ALL SELECT year, p, 0, count(*), 0 FROM c GROUP BY 1, 2),
s AS (SELECT year, cls, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM k GROUP BY 1, 2)
SELECT year, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(2 * tp / (t + p)), 6) AS macro_f1 FROM s GROUP BY 1""")
def _(spark, d):
    guess = F.element_at(F.array(*map(F.lit, PR)), (F.pmod(F.pmod("o_orderkey", F.lit(7)), F.lit(5)) + 1).cast("int"))
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("truth"), guess.alias("pred"))
    return rounded(rl.macro_f1(o, "truth", "pred", ["year"]), "accuracy", "macro_f1")


def two_models(spark, d):
    p = b.preds(spark, d)
    return p.select("sample", "year", "horizon", "y_true", F.col("y_prob").alias("p_a"), F.col("y_prob_b").alias("p_b"))


MC = "WITH " + b.preds_sql() + """, m AS (SELECT {k}, CAST(sum(CAST(a AND NOT b AS INTEGER)) AS BIGINT) AS b, CAST(sum(CAST(NOT a AND b AS INTEGER)) AS BIGINT) AS c FROM
  (SELECT *, CAST(y_prob >= {cut} AS INTEGER) = y_true AS a, CAST(y_prob_b >= {cut} AS INTEGER) = y_true AS b FROM preds) GROUP BY ALL)"""


@query("l07_mcnemar", MC.format(k="year", cut=0.5) + " SELECT year, b, c, round(greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / (b + c), 6) AS statistic FROM m")
def _(spark, d):
    return rounded(rl.mcnemar(two_models(spark, d), ["year"]), "statistic")


@query("l08_cluster_bootstrap")
def _(spark, d):
    return rl.cluster_bootstrap(b.preds(spark, d), ["horizon"], ["month"])


@query("l09_holm", MC.format(k="year, horizon", cut=0.55) + """, t AS (SELECT year, horizon, round(exp(-(greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / (b + c)) / 400), 9) AS p FROM m),
r AS (SELECT *, (count(*) OVER (PARTITION BY year) - row_number() OVER (PARTITION BY year ORDER BY p, horizon) + 1) * p AS raw FROM t)
SELECT year, horizon, p, round(least(max(raw) OVER (PARTITION BY year ORDER BY p, horizon ROWS UNBOUNDED PRECEDING), 1), 8) AS holm,
  round(least(min(raw) OVER (PARTITION BY year ORDER BY p, horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 8) AS hochberg FROM r""")
def _(spark, d):
    m = rl.mcnemar(two_models(spark, d), ["year", "horizon"], 0.55)
    t = m.select("year", "horizon", R(F.exp(-F.col("statistic") / 400), 9).alias("p"))
    return rounded(rl.holm(t, ["year"], "horizon"), "holm", "hochberg", n=8)


@query("l10_friedman", TWO + metrics_sql(["config", "year", "horizon"], "v2") + """, r AS (SELECT config, year, horizon, rank() OVER (PARTITION BY year, horizon ORDER BY auroc DESC) + (count(*) OVER (PARTITION BY year, horizon, auroc) - 1) / 2 AS r FROM met WHERE auroc IS NOT NULL),
m AS (SELECT config, avg(r) AS mr, count(*) AS n FROM r GROUP BY 1)
SELECT config, round(mr, 6) AS mean_rank, n AS datasets, round(12 * n / 6.0 * ((SELECT sum(mr * mr) FROM m) - 2 * 9 / 4.0), 6) AS friedman FROM m""")
def _(spark, d):
    m = materialise(mt.metric_table(two_configs(spark, d), ["config", "year", "horizon"]), "config_metrics")
    return rounded(rl.friedman(m, ["year", "horizon"], "config", "auroc"), "mean_rank", "friedman")


@query("l10_wilcoxon", """WITH d AS (SELECT l_extendedprice * (1 - l_discount) - l_quantity * 1500 AS d FROM lineitem), z AS (SELECT round(d, 2) AS d FROM d WHERE round(d, 2) <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM z)
SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, count(*) AS n FROM r""")
def _(spark, d):
    li = load(spark, d, "lineitem").select(R(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * 1500, 2).alias("a"), F.lit(0.0).alias("b"))
    return rl.wilcoxon(li, "a", "b")


def gradients(spark, d):
    e = load(spark, d, "embeddings")
    g = e.select(F.col("vec_id").alias("sample"), "label", F.pmod("vec_id", F.lit(3)).cast("int").alias("checkpoint"), F.col("embedding").alias("g"))
    return g.withColumn("lr", F.element_at(F.array(F.lit(0.1), F.lit(0.05), F.lit(0.01)), F.col("checkpoint") + 1))


INF = """WITH g AS (SELECT vec_id AS sample, label, CAST(vec_id % 3 AS INTEGER) AS cp, embedding AS e, [0.1::DOUBLE, 0.05, 0.01][CAST(vec_id % 3 + 1 AS INTEGER)] AS lr FROM embeddings),
x AS (SELECT sample, label, cp, lr, unnest(e)::DOUBLE AS v, unnest(range(1, len(e) + 1)) AS i FROM g),
vs AS (SELECT cp, i, sum(v) AS s FROM x WHERE label >= 5 GROUP BY 1, 2),
inf AS (SELECT x.sample, sum(lr * v * s) AS influence FROM x JOIN vs ON vs.cp = x.cp AND vs.i = x.i WHERE label < 5 GROUP BY 1)"""


def influences(spark, d):
    g = gradients(spark, d)
    return rl.influence(g.where("label < 5"), g.where("label >= 5"))


@query("l11_influence", INF + " SELECT sample, round(influence, 6) AS influence FROM inf")
def _(spark, d):
    return rounded(influences(spark, d), "influence")


SIGNS = rl.projection_signs(64, 8, seed=3)
DOTS = ", ".join(f"round(list_inner_product(e, {row}::DOUBLE[]) / sqrt(8), 6) AS p{j}" for j, row in enumerate(SIGNS))


@query("l12_projection", f"SELECT vec_id, {DOTS} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(spark, d):
    p = load(spark, d, "embeddings").select("vec_id", rl.project("embedding", 64, 8, seed=3).alias("p"))
    return p.select("vec_id", *[R(F.col("p")[j]).alias(f"p{j}") for j in range(8)])


@query("l13_curate_drop", INF + " SELECT sample, round(influence, 6) AS influence FROM inf WHERE influence >= (SELECT quantile_cont(influence, 0.04) FROM inf)")
def _(spark, d):
    return rounded(rl.curate(materialise(influences(spark, d), "influence"), "influence", 0.04), "influence")


@query("l13_curate_weight", INF + " SELECT sample, CASE WHEN influence < (SELECT quantile_cont(influence, 0.04) FROM inf) THEN 0.5::DOUBLE ELSE 1 END AS weight FROM inf")
def _(spark, d):
    return rl.curate(materialise(influences(spark, d), "influence"), "influence", 0.04, "weight").select("sample", "weight")


@query("l14_confident_joint", """WITH p AS (SELECT quality AS y, n_chars::DOUBLE / (n_chars + 1000) AS p1 FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
t AS (SELECT avg(CASE WHEN y = 0 THEN 1 - p1 END) AS t0, avg(CASE WHEN y = 1 THEN p1 END) AS t1 FROM p),
c AS (SELECT y, CASE WHEN 1 - p1 >= t0 AND p1 >= t1 THEN CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END WHEN 1 - p1 >= t0 THEN 0 WHEN p1 >= t1 THEN 1 END AS k FROM p, t)
SELECT y AS given, k AS confident, count(*) AS n FROM c WHERE k IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    p1 = F.col("n_chars") / (F.col("n_chars") + 1000)
    x = load(spark, d, "labels").join(docs, "doc_id").select("quality", F.array(1 - p1, p1).alias("probs"))
    return rl.confident_joint(x, "quality", "probs", 2)


@query("l15_active_select", INF + """, s AS (SELECT sample, influence, (sample % 97 + 1) / 99.0::DOUBLE AS p FROM inf)
SELECT sample, round(0.5 * -influence + 0.5 * -(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS priority FROM s ORDER BY 0.5 * -influence + 0.5 * -(p * ln(p) + (1 - p) * ln(1 - p)) DESC, sample LIMIT 40""")
def _(spark, d):
    s = influences(spark, d).withColumn("p", (F.pmod("sample", F.lit(97)) + 1) / 99.0)
    return rl.active_select(s, "influence", "p", "sample", 40).select("sample", R("priority").alias("priority"))


@query("l15_selection_recall", """WITH s AS (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3000), t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT count(*) AS truth, count(s.k) AS found, round(count(s.k)::DOUBLE / count(*), 6) AS recall FROM t LEFT JOIN s ON s.k = t.k""")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderpriority")
    top = o.orderBy(F.desc("o_totalprice"), "k").limit(3000)
    return rounded(rl.selection_recall(top, o.where("o_orderpriority = '1-URGENT'"), "k"), "recall")


@query("l16_jaccard", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000)
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS "both", (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either,
  round((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard""")
def _(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_custkey").alias("k")
    return rounded(rl.jaccard(o.where("o_orderpriority = '1-URGENT'").select(k), o.where("o_totalprice > 450000").select(k), "k"), "jaccard")


@query("l16_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def _(spark, d):
    return rounded(rl.spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "spearman")


@query("l17_sample_size", "WITH " + b.preds_sql() + " SELECT year, CAST(ceil(avg(y_true) * (1 - avg(y_true)) * (1.96 / 0.02) ** 2) AS BIGINT) AS needed, count(*) AS n FROM preds WHERE y_mask = 1 GROUP BY 1")
def _(spark, d):
    g = mt.observed(b.preds(spark, d)).groupBy("year").agg(F.avg("y_true").alias("p"), F.count(F.lit(1)).alias("n"))
    return g.select("year", rl.sample_size("p", 0.02).alias("needed"), "n")


@query("l18_consistency", TWO + metrics_sql(["config", "year"], "v2") + """, dl AS (SELECT year, max(CASE WHEN config = 'a' THEN auroc END) - max(CASE WHEN config = 'b' THEN auroc END) AS delta FROM met GROUP BY 1)
SELECT year, round(delta, 6) AS delta, CAST(sign(delta) = sign((SELECT avg(delta) FROM dl)) AS INTEGER) AS consistent FROM dl""")
def _(spark, d):
    m = mt.metric_table(two_configs(spark, d), ["config", "year"])
    at = lambda c: F.max(F.when(F.col("config") == c, F.col("auroc")))
    dl = materialise(m.groupBy("year").agg((at("a") - at("b")).alias("delta")), "deltas")
    return rounded(rl.consistency(dl, "year", "delta"), "delta")


# --- report tables -------------------------------------------------------------------------------


@query("k01_report_prevalence", "WITH RECURSIVE " + b.onset_labels_sql() + """ SELECT horizon, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives,
  round(sum(y * m) / greatest(sum(m), 1)::DOUBLE, 6) AS pos_rate FROM labels_h GROUP BY 1""")
def _(spark, d):
    return rounded(rp.prevalence(b.onset_labels(spark, d), ["horizon"]), "pos_rate")


MAIN = "SELECT met.{k}, n, pos, {met}, {bc} FROM met JOIN bc ON bc.{k} = met.{k}"


@query("k02_report_main", valid_sql() + metrics_sql(["year"]) + budget_sql(["year"], [0.1]) + " " + MAIN.format(k="year", met=MET, bc=BC))
def _(spark, d):
    return rounded(four(rp.main_table(b.preds(spark, d), ["year"])), "thr", "hit", "fa_per_100")


@query("k03_report_horizons", valid_sql() + metrics_sql(["horizon"]) + budget_sql(["horizon"], [0.1]) + " " + MAIN.format(k="horizon", met=MET, bc=BC))
def _(spark, d):
    return rounded(four(rp.main_table(b.preds(spark, d), ["horizon"])), "thr", "hit", "fa_per_100")


@query("k05_report_operational", valid_sql() + metrics_sql(["year"]) + budget_sql(["year"], [0.1]) + f" SELECT met.year, n, pos, {BC} FROM met JOIN bc ON bc.year = met.year")
def _(spark, d):
    return rounded(rp.operational_table(rp.main_table(b.preds(spark, d), ["year"]), ["year"]), "thr", "hit", "fa_per_100")


@query("k06_report_ablation", TWO + metrics_sql(["config", "horizon"], "v2") + f" SELECT config, horizon, n, pos, {MET} FROM met")
def _(spark, d):
    return four(rp.ablation(two_configs(spark, d), ["config", "horizon"]))


@query("k07_span_effect", valid_sql() + metrics_sql(["year"]) + " SELECT CAST(year - (SELECT min(year) FROM preds) AS INTEGER) AS span, year, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM met")
def _(spark, d):
    return rounded(rp.figure_data("span_effect", b.preds(spark, d)), "auroc", "auprc")


@query("k07_support_trend", valid_sql(True) + metrics_sql(["entity", "horizon"]) + """ SELECT horizon, count(*) AS groups, round(corr(pos, auroc), 6) AS corr, round(regr_slope(auroc, pos), 6) AS slope,
  round(regr_intercept(auroc, pos), 6) AS intercept FROM met WHERE auroc IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rounded(rp.figure_data("support_trend", b.preds(spark, d, True)), "corr", "slope", "intercept")


@query("k07_reliability_bins", valid_sql() + """ SELECT horizon, CAST(floor(y_prob * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(y_prob), 6) AS mean_p, round(avg(y_true), 6) AS event_rate FROM v GROUP BY 1, 2""")
def _(spark, d):
    return rounded(rp.figure_data("reliability", b.preds(spark, d)), "mean_p", "event_rate")


@query("k08_split_inventory", NEXT + """ SELECT split, sum(CAST(horizon = 1 AS BIGINT))::BIGINT AS n, sum(CASE WHEN horizon = 1 THEN m END)::BIGINT AS valid_h1, sum(CASE WHEN horizon = 1 THEN y * m END)::BIGINT AS pos_h1,
  sum(CASE WHEN horizon = 3 THEN m END)::BIGINT AS valid_h3, sum(CASE WHEN horizon = 3 THEN y * m END)::BIGINT AS pos_h3 FROM sp GROUP BY 1""")
def _(spark, d):
    return rp.split_inventory(next_year(spark, d), [1, 3])
