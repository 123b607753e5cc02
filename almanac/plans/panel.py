"""Panel build, anomaly scores, episodes and labels (E, D5, D6, D10, D11, C4)."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from ..operators import surge, timeseries as ts
from . import base as b
from ..session import materialise
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


@query("flagship_label_stats", "WITH RECURSIVE " + b.onset_labels_sql() + """
SELECT horizon, CAST(year(month) AS INTEGER) AS year, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives,
       round(sum(y * m) / greatest(sum(m), 1)::DOUBLE, 6) AS pos_rate
FROM labels_h GROUP BY 1, 2""")
def _(spark, d):
    lab = b.onset_labels(spark, d).withColumn("year", F.year("month"))
    return surge.label_stats(lab, ["horizon", "year"]).withColumn("pos_rate", R("pos_rate"))


CUST = "WITH RECURSIVE " + b.onset_labels_sql((1.1,)).replace(b.PRICE, """price AS (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2)""")


@query("flagship_customer_label_stats", CUST + """
SELECT horizon, CAST(year(month) AS INTEGER) AS year, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives,
       round(sum(y * m) / greatest(sum(m), 1)::DOUBLE, 6) AS pos_rate
FROM labels_h GROUP BY 1, 2""")
def _(spark, d):
    """The same chain with every customer as an entity: the panel grows with the customer table."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), b.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("raw"))
    p = ts.complete_months(materialise(o, "customer-price"), ["entity"])
    p = p.withColumn("price", ts.ffill("raw", "entity", "month"))
    z = surge.ifpa_fixed(p, ["entity"], gamma=0.6, y0=1995, y1=1998)
    # Two observations per calendar month give scores of exactly 1, so the threshold lies beside it.
    lab = surge.make_labels(surge.flag_family(z, [1.1]), ["entity", "thr"], "t", [1, 3], timing="onset", refractory=2)
    return surge.label_stats(lab.withColumn("year", F.year("month")), ["horizon", "year"]).withColumn("pos_rate", R("pos_rate"))


@query("c04_complete_months", "WITH " + b.PANEL + " SELECT entity, month, t, round(raw, 6) AS raw, round(price, 6) AS price FROM panel")
def _(spark, d):
    return b.panel(spark, d).select("entity", "month", "t", R("raw", 6).alias("raw"), R("price", 6).alias("price"))


@query("e01_ffill", "WITH " + b.DAILY_PANEL + """ SELECT station, day,
  round(last_value(stage IGNORE NULLS) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS stage FROM dpanel""")
def _(spark, d):
    return b.daily_panel(spark, d).select("station", "day", R(ts.ffill("stage", "station", "day")).alias("stage"))


@query("e02_log_growth", "WITH " + b.GROWTH + " SELECT entity, t, round(cq, 6) AS cq, round(ca, 6) AS ca FROM growth")
def _(spark, d):
    p = b.panel(spark, d)
    return p.select("entity", "t", R(ts.log_growth("price", 3, "entity", "month")).alias("cq"),
                    R(ts.log_growth("price", 12, "entity", "month")).alias("ca"))


@query("e03_ifpa_fixed", "WITH " + b.SCORED + " SELECT entity, t, round(z, 5) AS z FROM scored")
def _(spark, d):
    return b.scored(spark, d).select("entity", "t", R("z", 5).alias("z"))


@query("e03_ifpa_restricted_index", "WITH " + b.SCORED.replace("BETWEEN 1995 AND 1998", "BETWEEN 1997 AND 1999")
       .replace("FROM price), (SELECT unnest(generate_series(lo, hi", "FROM price), (SELECT unnest(generate_series(greatest(lo, DATE '1997-01-01'), hi")
       + " SELECT entity, t, round(z, 5) AS z FROM scored")
def _(spark, d):
    p = b.panel(spark, d)
    # Fill happens after the restriction, as the series is cut to the index first.
    cut = p.where(F.col("month") >= F.lit("1997-01-01").cast("date")).withColumn("price", ts.ffill("raw", "entity", "month"))
    return surge.ifpa_fixed(cut, ["entity"], gamma=0.6, y0=1997, y1=1999).select("entity", "t", R("z", 5).alias("z"))


TRAILING = b.GROWTH + """,
tr AS (SELECT entity, t, cq, ca, count(cq) OVER w AS nq, avg(cq) OVER w AS mq, stddev_pop(cq) OVER w AS sq,
              count(ca) OVER w AS na, avg(ca) OVER w AS ma, stddev_pop(ca) OVER w AS sa
       FROM growth WINDOW w AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query("e04_ifpa_trailing", "WITH " + TRAILING + """ SELECT entity, t, round(
  0.4::DOUBLE * (CASE WHEN nq >= 6 AND sq > 1e-9 THEN (cq - mq) / sq END) + 0.6::DOUBLE * (CASE WHEN na >= 12 AND sa > 1e-9 THEN (ca - ma) / sa END), 5) AS z FROM tr""")
def _(spark, d):
    return surge.ifpa_trailing(b.panel(spark, d), ["entity"], gamma=0.4, years=2).select("entity", "t", R("z", 5).alias("z"))


MOM = b.PANEL + ", mom AS (SELECT *, price / lag(price) OVER (PARTITION BY entity ORDER BY month) - 1 AS mom FROM panel)"


@query("e05_pct_change", "WITH " + MOM + " SELECT entity, t, round(mom, 6) AS mom FROM mom")
def _(spark, d):
    return b.panel(spark, d).select("entity", "t", R(ts.pct_change("price", "entity", "month")).alias("mom"))


@query("e06_surge_rolling", "WITH " + MOM + """,
r AS (SELECT entity, t, mom, count(mom) OVER w AS n, avg(mom) OVER w AS mu, stddev_pop(mom) OVER w AS sd FROM mom
      WINDOW w AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
z AS (SELECT entity, t, CASE WHEN n >= 3 AND sd > 1e-9 THEN (mom - mu) / sd END AS z FROM r)
SELECT entity, t, round(z, 5) AS z, CAST(coalesce(z > 1.3, false) AS INTEGER) AS flag, CAST(z IS NOT NULL AS INTEGER) AS valid FROM z""")
def _(spark, d):
    s = surge.surge_rolling(b.panel(spark, d), ["entity"])
    return surge.flag_family(s, [1.3], strict=True).select("entity", "t", R("z", 5).alias("z"), "flag", "valid")


def _quantile_sql(q):
    return "WITH " + MOM + f""",
c AS (SELECT entity, quantile_cont(mom, {q}) AS cut FROM mom GROUP BY 1)
SELECT m.entity, t, round(mom - cut, 8) AS z, CAST(coalesce(round(mom - cut, 8) > 0, false) AS INTEGER) AS flag,
       CAST(mom IS NOT NULL AS INTEGER) AS valid FROM mom m JOIN c ON c.entity = m.entity"""


@query("e07_surge_percentile", _quantile_sql(0.95))
def _(spark, d):
    s = surge.surge_percentile(b.panel(spark, d), ["entity"], p=95).withColumn("z", R("z", 8))
    return surge.flag_family(s, [0.0], strict=True).select("entity", "t", "z", "flag", "valid")


@query("e08_surge_pot", _quantile_sql(0.9))
def _(spark, d):
    s = surge.surge_pot(b.panel(spark, d), ["entity"], q=0.1).withColumn("z", R("z", 8))
    return surge.flag_family(s, [0.0], strict=True).select("entity", "t", "z", "flag", "valid")


@query("e09_threshold_family", "WITH " + b.flagged_sql((1.0, 1.8, 2.5)) + " SELECT entity, t, thr, flag, valid FROM flagged")
def _(spark, d):
    return b.flagged(spark, d, (1.0, 1.8, 2.5)).select("entity", "t", "thr", "flag", "valid")


RUNS = """, chg AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY entity, thr ORDER BY t) THEN 1 ELSE 0 END AS c FROM flagged),
isl AS (SELECT *, sum(c) OVER (PARTITION BY entity, thr ORDER BY t) AS rid FROM chg),
runs AS (SELECT *, count(*) OVER (PARTITION BY entity, thr, rid) AS len FROM isl)"""


@query("e10_min_duration", "WITH " + b.flagged_sql() + RUNS + " SELECT entity, thr, t, CAST(flag = 1 AND len >= 2 AS INTEGER) AS flag FROM runs")
def _(spark, d):
    return ts.min_duration(b.flagged(spark, d), "flag", ["entity", "thr"], "t", 2).select("entity", "thr", "t", "flag")


@query("e11_onsets", "WITH RECURSIVE " + b.flagged_sql() + b.onset_sql(r=4) + " SELECT entity, thr, t, onset FROM onsets")
def _(spark, d):
    return ts.onsets(b.flagged(spark, d), "flag", ["entity", "thr"], "t", 4).select("entity", "thr", "t", "onset")


@query("e12_label_exact", "WITH " + b.flagged_sql() + """ SELECT entity, thr, t,
  coalesce(lead(flag, 3) OVER w, 0) AS y, coalesce(lead(valid, 3) OVER w, 0) AS m FROM flagged WINDOW w AS (PARTITION BY entity, thr ORDER BY t)""")
def _(spark, d):
    f = b.flagged(spark, d)
    y, m = ts.label_exact("flag", "valid", 3, ["entity", "thr"], "t")
    return f.select("entity", "thr", "t", y.alias("y"), m.alias("m"))


@query("e13_label_window", "WITH " + b.flagged_sql() + b.labels_sql("flagged", "flag", (1, 3)) + " SELECT entity, thr, t, horizon, y, m FROM labels_h")
def _(spark, d):
    f = b.flagged(spark, d)
    return surge.make_labels(f, ["entity", "thr"], "t", [1, 3], timing="window").select("entity", "thr", "t", "horizon", "y", "m")


@query("e13_label_onset_family", "WITH RECURSIVE " + b.onset_labels_sql((1.0, 1.8, 2.5), (1, 3, 6)) + " SELECT entity, thr, t, horizon, y, m FROM labels_h")
def _(spark, d):
    return b.onset_labels(spark, d, (1.0, 1.8, 2.5), (1, 3, 6)).select("entity", "thr", "t", "horizon", "y", "m")


@query("e14_windows", "WITH " + b.PANEL + """,
w AS (SELECT entity, t, count(*) OVER f AS n, sum(price) OVER f AS s, first_value(price) OVER f AS p0, max(t) OVER (PARTITION BY entity) AS tl
      FROM panel WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT entity, CAST(t AS INTEGER) AS t_end, CAST(n AS INTEGER) AS steps, round(s, 2) AS total, round(p0, 6) AS first_price
FROM w WHERE n = 12 AND t >= 12""")
def _(spark, d):
    w = ts.windows(b.panel(spark, d), ["price"], ["entity"], "t", 12, 1)
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["price"])
    return w.select("entity", "t_end", F.size("steps").alias("steps"), R(total, 2).alias("total"),
                    R(F.col("steps")[0]["price"], 6).alias("first_price"))


@query("e15_episodes", "WITH " + b.flagged_sql() + RUNS + """
SELECT entity, thr, min(t) AS start_t, max(t) AS end_t, count(*) AS length, round(max(z), 5) AS peak FROM runs WHERE flag = 1 GROUP BY entity, thr, rid""")
def _(spark, d):
    return ts.episodes(b.flagged(spark, d), "flag", ["entity", "thr"], "t", "z").withColumn("peak", R("peak", 5))


def _roll(n, agg):
    return f"{agg}(stage) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"


@query("e16_rolling", "WITH " + b.DAILY + f""" SELECT station, day, round({_roll(7, 'avg')}, 6) AS mean7, round({_roll(14, 'sum')}, 6) AS sum14,
  round(stage - {_roll(30, 'avg')}, 6) AS anomaly30 FROM daily""")
def _(spark, d):
    r = lambda n, a="avg": ts.rolling("stage", n, "station", "day", a)
    return b.daily(spark, d).select("station", "day", R(r(7)).alias("mean7"), R(r(14, "sum")).alias("sum14"),
                                    R(F.col("stage") - r(30)).alias("anomaly30"))


@query("e17_lags", "WITH " + b.PANEL + """ SELECT entity, t, round(lag(price, 1) OVER w, 6) AS price_lag1, round(lag(price, 4) OVER w, 6) AS price_lag4,
  round(lag(price, 8) OVER w, 6) AS price_lag8, round(lead(price, 2) OVER w, 6) AS price_lead2 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY t)""")
def _(spark, d):
    cols = ts.lags("price", [1, 4, 8, -2], "entity", "t")
    return b.panel(spark, d).select("entity", "t", *[R(c, 6).alias(k) for k, c in cols.items()])


@query("e18_interpolate", "WITH " + b.DAILY_PANEL + """,
i AS (SELECT *, last_value(stage IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN stage IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0,
             first_value(stage IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN stage IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1
      FROM dpanel WINDOW p AS (PARTITION BY station ORDER BY t ROWS UNBOUNDED PRECEDING),
                         f AS (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, t, round(coalesce(stage, CASE WHEN t1 - t0 - 1 <= 2 THEN v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)) END), 6) AS stage FROM i""")
def _(spark, d):
    return b.daily_panel(spark, d).select("station", "t", R(ts.interpolate("stage", "station", "t", 2)).alias("stage"))


@query("e19_percentile_persistence", "WITH " + b.DAILY + """,
pr AS (SELECT station, day, percent_rank() OVER (PARTITION BY station ORDER BY stage) AS pr FROM daily),
fl AS (SELECT *, CAST(pr >= 0.6 AS INTEGER) AS high FROM pr),
ch AS (SELECT *, CASE WHEN high IS DISTINCT FROM lag(high) OVER (PARTITION BY station ORDER BY day) THEN 1 ELSE 0 END AS c FROM fl),
ri AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY day) AS rid FROM ch)
SELECT station, day, round(pr, 6) AS pr, CAST(CASE WHEN high = 1 THEN row_number() OVER (PARTITION BY station, rid ORDER BY day) ELSE 0 END AS INTEGER) AS persistence FROM ri""")
def _(spark, d):
    p = b.daily(spark, d).withColumn("pr", ts.percent_position("stage", "station"))
    p = p.withColumn("high", (F.col("pr") >= 0.6).cast("int"))
    return ts.persistence(p, "high", ["station"], "day").select("station", "day", R("pr").alias("pr"), "persistence")


@query("e20_since_event", "WITH " + b.DAILY_PANEL + """ SELECT station, t,
  t - last_value(CASE WHEN peak >= 150 THEN t END IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS UNBOUNDED PRECEDING) AS since,
  CAST(count(CASE WHEN peak >= 150 THEN 1 END) OVER (PARTITION BY station ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM dpanel""")
def _(spark, d):
    p = b.daily_panel(spark, d).withColumn("hit", F.coalesce((F.col("peak") >= 150).cast("int"), F.lit(0)))
    w = Window.partitionBy("station").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("station", "t", ts.since_event("hit", "t", "station").alias("since"), F.sum("hit").over(w).alias("so_far"))


@query("e21_spread_vs_median", "WITH " + b.PANEL + """ SELECT entity, t, round(price - quantile_cont(price, 0.5) OVER
  (PARTITION BY entity ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS spread FROM panel""")
def _(spark, d):
    return b.panel(spark, d).select("entity", "t", R(ts.spread_vs_median("price", "entity", "t", 12) + 1e-9, 6).alias("spread"))


@query("e22_lag_kernel", "WITH " + b.PANEL + """ SELECT entity, t, round(0.5 * lag(price, 1) OVER w + 0.3 * lag(price, 2) OVER w + 0.2 * lag(price, 3) OVER w + 1e-9, 6) AS upstream
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY t)""")
def _(spark, d):
    return b.panel(spark, d).select("entity", "t", R(ts.lag_kernel("price", {1: 0.5, 2: 0.3, 3: 0.2}, "entity", "t") + 1e-9, 6).alias("upstream"))


@query("e23_event_study", "WITH RECURSIVE " + b.flagged_sql((1.0,)) + b.onset_sql() + """,
hit AS (SELECT p.t - o.t AS off, p.price FROM onsets o JOIN panel p ON p.entity = o.entity AND p.t BETWEEN o.t - 3 AND o.t + 3 WHERE o.onset = 1),
bs AS (SELECT avg(price) AS bl FROM hit WHERE off < 0)
SELECT CAST(off AS INTEGER) AS "offset", round(avg(price), 6) AS mean_value, count(price) AS n, round(avg(price) - (SELECT bl FROM bs), 6) AS gap FROM hit GROUP BY off""")
def _(spark, d):
    ev = ts.onsets(b.flagged(spark, d, (1.0,)), "flag", ["entity", "thr"], "t", 2).where("onset = 1").select("entity", "t")
    out = ts.event_study(b.panel(spark, d), ev, ["entity"], "t", "price", 3)
    return out.withColumns({"mean_value": R("mean_value", 6), "gap": R("gap", 6)})


@query("e24_delta", "WITH " + b.DAILY_PANEL + " SELECT station, t, round(stage - lag(stage, 7) OVER (PARTITION BY station ORDER BY t), 6) AS change7 FROM dpanel")
def _(spark, d):
    return b.daily_panel(spark, d).select("station", "t", R(ts.delta("stage", 7, "station", "t")).alias("change7"))


@query("d05_seasonal_baseline", "WITH " + b.SCORED + """ SELECT entity, CAST(moy AS INTEGER) AS moy, round(mu_cq, 6) AS mu_cq, round(sd_cq, 6) AS sd_cq,
  round(mu_ca, 6) AS mu_ca, round(sd_ca, 6) AS sd_ca FROM base""")
def _(spark, d):
    p = b.panel(spark, d).where(F.year("month").between(1995, 1998))
    g = p.select("entity", "month", ts.log_growth("price", 3, "entity", "month").alias("cq"), ts.log_growth("price", 12, "entity", "month").alias("ca"))
    s = surge.seasonal_baseline(g, ["cq", "ca"], ["entity"])
    return s.select("entity", "moy", *[R(c).alias(c) for c in ("mu_cq", "sd_cq", "mu_ca", "sd_ca")])


@query("d07_prevalence", "WITH RECURSIVE " + b.onset_labels_sql() + """ SELECT horizon, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives,
  round(sum(y * m) / greatest(sum(m), 1)::DOUBLE, 6) AS pos_rate FROM labels_h GROUP BY 1""")
def _(spark, d):
    return surge.label_stats(b.onset_labels(spark, d), ["horizon"]).withColumn("pos_rate", R("pos_rate"))


@query("d10_episodes_per_year", "WITH RECURSIVE " + b.flagged_sql() + b.onset_sql() + """
SELECT thr, CAST(year(month) AS INTEGER) AS year, CAST(sum(onset) AS BIGINT) AS episodes FROM onsets GROUP BY 1, 2""")
def _(spark, d):
    o = ts.onsets(b.flagged(spark, d), "flag", ["entity", "thr"], "t", 2)
    return o.groupBy("thr", F.year("month").alias("year")).agg(F.sum("onset").alias("episodes"))


@query("d11_positive_matrix", "WITH RECURSIVE " + b.onset_labels_sql((1.0,), (1, 3, 6)) + """
SELECT CAST(year(month) AS INTEGER) AS year, CAST(sum(CASE WHEN horizon = 1 THEN y * m END) AS BIGINT) AS h1,
  CAST(sum(CASE WHEN horizon = 3 THEN y * m END) AS BIGINT) AS h3, CAST(sum(CASE WHEN horizon = 6 THEN y * m END) AS BIGINT) AS h6 FROM labels_h GROUP BY 1""")
def _(spark, d):
    lab = b.onset_labels(spark, d, (1.0,), (1, 3, 6)).dropDuplicates(["entity", "t", "horizon"])
    out = lab.groupBy(F.year("month").alias("year")).pivot("horizon", [1, 3, 6]).agg(F.sum(F.col("y") * F.col("m")))
    return out.select("year", *[F.col(str(h)).cast("bigint").alias(f"h{h}") for h in (1, 3, 6)])
