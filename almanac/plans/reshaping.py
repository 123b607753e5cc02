"""Reshaping, summaries, sets, cells (D, O, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import cube as cb, joins as jn, metrics as mt, reshape as rs, timeseries as ts
from ..operators.patterns import quantiles_wide
from ..session import materialise
from . import base as b
from .alignment import ANNUAL, MICRO, annual, micro
from .evaluation import MET, four, metrics_sql, valid_sql
from .registry import load, query

R = lambda c, n=6: F.round(c, n)
PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("d01_pivot_mean", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, " + ", ".join(
    f"round(avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 4) AS p{i}" for i, p in enumerate(PRIO, 1)) + " FROM orders GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice")
    w = rs.pivot_mean(o, ["year"], "o_orderpriority", "o_totalprice", PRIO)
    return w.select("year", *[R(F.col(f"`{p}`"), 4).alias(f"p{i}") for i, p in enumerate(PRIO, 1)])


@query("d02_melt_years", "WITH " + ANNUAL + " SELECT entity, year, sum(value) AS value FROM annual GROUP BY 1, 2")
def _(spark, d):
    w = annual(spark, d).groupBy("entity").pivot("year").agg(F.sum("value"))
    return rs.melt_years(w, ["entity"])


LONGD = """, long AS (SELECT day, 'station_' || station AS var, stage AS value FROM dpanel)"""


@query("d03_screen_vars", "WITH " + b.DAILY_PANEL + LONGD + """, k AS (SELECT var FROM long GROUP BY 1 HAVING avg(CAST(value IS NULL AS INTEGER)) <= 0.1)
SELECT day, var, round(value, 6) AS value FROM long WHERE var IN (SELECT var FROM k)""")
def _(spark, d):
    long = b.daily_panel(spark, d).select("day", F.concat(F.lit("station_"), "station").alias("var"), F.col("stage").alias("value"))
    return rs.screen_vars(materialise(long, "long"), "var", "value", 0.1).select("day", "var", R("value").alias("value"))


def _line_long(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("var"), F.col("l_extendedprice").alias("value"))


def _scaled(spark, d, mode):
    x = _line_long(spark, d)
    return rs.Scaler(mode).fit(x).transform(x).select("l_orderkey", "l_linenumber", "value", "var", R("scaled").alias("scaled"))


SC = "SELECT l_orderkey, l_linenumber, l_extendedprice AS value, l_returnflag AS var, round({e}, 6) AS scaled FROM lineitem JOIN (SELECT l_returnflag AS rf, {s} FROM lineitem GROUP BY 1) s ON rf = l_returnflag"


@query("d04_scaler_robust", SC.format(e="(l_extendedprice - md) / ((CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END) + 1e-6)",
       s="quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS md, quantile_cont(l_extendedprice, 0.75) AS q3"))
def _(spark, d):
    return _scaled(spark, d, "robust")


@query("d04_scaler_zscore", SC.format(e="(l_extendedprice - m) / s", s="avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s"))
def _(spark, d):
    return _scaled(spark, d, "zscore")


@query("d04_scaler_minmax", SC.format(e="(l_extendedprice - lo) / (hi - lo + 1e-6)", s="min(l_extendedprice) AS lo, max(l_extendedprice) AS hi"))
def _(spark, d):
    return _scaled(spark, d, "minmax")


@query("d04_scaler_log", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS scaled FROM lineitem")
def _(spark, d):
    return _scaled(spark, d, "log").select("l_orderkey", "l_linenumber", "scaled")


@query("d04_scaler_pct", "WITH " + b.PANEL + " SELECT entity, t, round(coalesce(price / lag(price) OVER (PARTITION BY entity ORDER BY t) - 1, 0), 6) AS scaled FROM panel")
def _(spark, d):
    p = b.panel(spark, d).select("entity", "t", F.lit("price").alias("var"), F.col("price").alias("value"))
    return rs.Scaler("pct").fit(p).transform(p, ["entity"], "t").select("entity", "t", R("scaled").alias("scaled"))


@query("d16_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS missing, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"
                                       for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, d):
    p = rs.profile(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return p.withColumns({"mean": R("mean"), "sd": R("sd")})


@query("d17_basin_mean", "WITH " + b.CELLS + """, w AS (SELECT DISTINCT y, x, y // 16 AS basin, 1.0::DOUBLE + x % 4 AS w FROM cells)
SELECT month, CAST(basin AS INTEGER) AS basin, c, round(sum(w * v) / sum(w), 6) AS basin_mean FROM cells JOIN w ON w.y = cells.y AND w.x = cells.x GROUP BY 1, 2, 3""")
def _(spark, d):
    c = materialise(b.cells(spark, d), "cells")
    w = c.select("y", "x").distinct().withColumns({"basin": F.floor(F.col("y") / 16).cast("int"), "w": 1.0 + F.pmod("x", F.lit(4))})
    return rs.basin_mean(c, w, ["y", "x"], ["month", "basin", "c"], "v").withColumn("basin_mean", R("basin_mean"))


@query("d18_resample_weekly", """WITH wk AS (SELECT user_id AS station, CAST(date_trunc('week', ts) AS DATE) AS period, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1, 2),
hr AS (SELECT user_id AS station, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2),
lo AS (SELECT station, CAST(date_trunc('week', h) AS DATE) AS period, CAST(sum(CAST(v < 20 AS INTEGER)) AS BIGINT) AS hours_below FROM hr GROUP BY 1, 2)
SELECT wk.station, wk.period, round(median, 6) AS median, round(median - lag(median) OVER (PARTITION BY wk.station ORDER BY wk.period), 6) AS change, hours_below
FROM wk JOIN lo ON lo.station = wk.station AND lo.period = wk.period""")
def _(spark, d):
    e = b.events(spark, d).withColumn("period", F.date_trunc("WEEK", "ts").cast("date"))
    med = quantiles_wide(e, ["station", "period"], "value", {"median": 0.5})
    hr = e.groupBy("station", "period", F.date_trunc("HOUR", "ts")).agg(F.avg("value").alias("v"))
    low = hr.groupBy("station", "period").agg(F.sum((F.col("v") < 20).cast("bigint")).alias("hours_below"))
    j = med.join(low, ["station", "period"])
    return j.select("station", "period", R("median").alias("median"), R(ts.delta("median", 1, "station", "period")).alias("change"), "hours_below")


@query("d18_resample_monthly", """SELECT user_id AS station, CAST(date_trunc('month', ts) AS DATE) AS period, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, arg_max(value, ts) AS last FROM events GROUP BY 1, 2""")
def _(spark, d):
    return jn.align(b.events(spark, d), ["station"], "ts", "MONTH", {
        "total": R(F.sum("value")), "mean": R(F.avg("value")), "last": F.max_by("value", F.struct("ts", "event_id"))})


@query("d19_hierarchy", "WITH " + MICRO + """ SELECT n_regionkey AS region, entity AS nation, segment, CAST(3 - (GROUPING(n_regionkey) + GROUPING(entity) + GROUPING(segment)) AS INTEGER) AS depth, round(sum(value), 2) AS total
FROM micro JOIN nation ON n_nationkey = entity GROUP BY ROLLUP (n_regionkey, entity, segment)""")
def _(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("region"))
    m = micro(spark, d).join(n, "entity").withColumnRenamed("entity", "nation")
    return rs.hierarchy(m, ["region", "nation", "segment"], "value").withColumn("total", R("total", 2))


@query("d20_crosscheck", """WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS published FROM orders GROUP BY 1),
l AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_extendedprice) AS ours FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o.year, round(published, 2) AS published, round(ours, 2) AS ours, round(abs(ours - published) / published, 6) AS rel_error, CAST(abs(ours - published) / published <= 0.2 AS INTEGER) AS ok FROM o LEFT JOIN l ON l.year = o.year""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("rev"))
    ours = li.join(o, "o_orderkey")
    out = rs.crosscheck(ours, o.groupBy("year").agg(F.sum("o_totalprice").alias("t")), ["year"], "rev", "t", 0.2)
    return out.withColumns({"published": R("published", 2), "ours": R("ours", 2), "rel_error": R("rel_error")})


@query("d21_missing_rate", "WITH " + b.DAILY_PANEL + " SELECT station, count(*) AS expected, count(stage) AS observed, round(1 - count(stage)::DOUBLE / count(*), 6) AS missing_rate FROM dpanel GROUP BY 1")
def _(spark, d):
    return rs.missing_rate(b.daily_panel(spark, d), ["station"], "stage").withColumn("missing_rate", R("missing_rate"))


Q = "least(greatest(y_prob, 1e-6), 1 - 1e-6)"


@query("d22_masked_loss", "WITH " + b.preds_sql() + f""" SELECT round(sum(-(y_true * ln({Q}) + (1 - y_true) * ln(1 - {Q})) * y_mask * (CASE WHEN horizon = 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)) / greatest(sum(y_mask), 1), 6) AS loss FROM preds""")
def _(spark, d):
    return rs.masked_loss(b.preds(spark, d), sc.bce("y_true", "y_prob"), weights={3: 2.0}).withColumn("loss", R("loss"))


@query("d23_anomaly_vs_normal", "WITH " + b.PANEL + """, nm AS (SELECT entity, month(month) AS moy, avg(price) AS mu, stddev_pop(price) AS sd FROM panel WHERE year(month) <= 1998 GROUP BY 1, 2)
SELECT p.entity, t, round((price - mu) / nullif(sd, 0), 5) AS anomaly FROM panel p LEFT JOIN nm ON nm.entity = p.entity AND nm.moy = month(p.month)""")
def _(spark, d):
    p = b.panel(spark, d).withColumn("moy", F.month("month"))
    nm = p.where("year(month) <= 1998").groupBy("entity", "moy").agg(F.avg("price").alias("mu"), F.stddev_pop("price").alias("sd"))
    return rs.anomaly_vs_normal(p, nm, ["entity", "moy"], "price").select("entity", "t", R("anomaly", 5).alias("anomaly"))


@query("d24_command_kpis", """WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, CAST(event_type IN ('view', 'purchase') AS INTEGER) AS intended, CAST(value >= 20 AS INTEGER) AS executed, value AS latency, ts FROM events)
SELECT arm, round(sum(CAST(intended = 0 AND executed = 1 AS INTEGER)) / count(DISTINCT date_trunc('hour', ts))::DOUBLE, 6) AS far_per_hour,
  round(sum(CAST(intended = 1 AND executed = 0 AS INTEGER))::DOUBLE / sum(intended), 6) AS frr, round(avg(CASE WHEN executed = 1 THEN latency END), 6) AS latency,
  round(sum(CAST(intended = 0 AND executed = 0 AS INTEGER))::DOUBLE / sum(1 - intended), 6) AS correct_silence FROM c GROUP BY 1""")
def _(spark, d):
    c = load(spark, d, "events").select(
        F.when(F.pmod("user_id", F.lit(2)) == 0, "a").otherwise("b").alias("arm"), F.col("event_type").isin("view", "purchase").cast("int").alias("intended"),
        (F.col("value") >= 20).cast("int").alias("executed"), F.col("value").alias("latency"), "ts")
    k = rs.command_kpis(c, ["arm"], F.countDistinct(F.date_trunc("HOUR", F.col("ts"))))
    return k.withColumns({x: R(x) for x in ("far_per_hour", "frr", "latency", "correct_silence")})


# --- sorting, limits, sets -----------------------------------------------------------------------


@query("o01_sorted_sink", "WITH " + b.PRICE + " SELECT entity, month, round(price, 6) AS price FROM price ORDER BY entity, month")
def _(spark, d):
    return b.nation_price(spark, d).select("entity", "month", R("price").alias("price")).orderBy("entity", "month")


@query("o05_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o07_top_candidates", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def _(spark, d):
    return rs.top_candidates(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 3, "event_id")


@query("o08_dedupe", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate)::DATE AS day FROM orders GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return rs.dedupe(o, ["o_custkey"], ["day", "o_orderkey"])


SETS = {
    "concat": "SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events",
    "union": "SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events",
    "difference": "SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events",
}
for _kind, _sql in SETS.items():
    @query(f"o09_set_{_kind}", _sql)
    def _(spark, d, kind=_kind):
        a = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
        return rs.set_op(a, load(spark, d, "events").select(F.col("user_id").alias("k")), kind)


# --- cells -----------------------------------------------------------------------------------------

C = "WITH " + b.CELLS


@query("f01_months", "WITH s AS (SELECT min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS lo, max(CAST(date_trunc('month', o_orderdate) AS DATE)) AS hi FROM orders) SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS t, CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM s)")
def _(spark, d):
    lo, hi = load(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyyMM"), F.date_format(F.max("o_orderdate"), "yyyyMM")).first()
    return sc.months(spark, lo, hi)


@query("f02_prepare_cells", C + """ SELECT month, c, y, x, round(ln(1 + least(greatest(v, 0), 500) / (24.0::DOUBLE * day(last_day(month)))), 6) AS v_norm, CAST(v IS NULL AS TINYINT) AS land, CAST(v = 0 AS TINYINT) AS quiet, CAST(v > 0 AS TINYINT) AS active FROM cells""")
def _(spark, d):
    return cb.prepare_cells(b.cells(spark, d), 500.0).withColumn("v_norm", R("v_norm")).drop("v")


@query("f03_to_sparse", C + " SELECT month, c, y, x, v FROM cells WHERE v > 0 AND c IN ('A', 'R')")
def _(spark, d):
    return cb.to_sparse(b.cells(spark, d), ["A", "R"])


@query("f04_to_dense", C + """, m AS (SELECT DISTINCT month FROM cells), g AS (SELECT month, c, y, x FROM m, (VALUES ('A'), ('N'), ('R')) k(c), range(64) a(y), range(64) b(x)),
d AS (SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN cells s ON s.month = g.month AND s.c = g.c AND s.y = g.y AND s.x = g.x)
SELECT month, c, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(CAST(v = 0 AS INTEGER)) AS BIGINT) AS zeros, sum(v) AS total FROM d GROUP BY 1, 2, 3""")
def _(spark, d):
    dense = cb.to_dense(materialise(b.cells(spark, d), "cells"), ["A", "N", "R"], 64, 64)
    return dense.groupBy("month", "c", "y").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") == 0).cast("bigint")).alias("zeros"), F.sum("v").alias("total"))


@query("f05_any_active", C + " SELECT month, y, x, max(CAST(v > 0 AS INTEGER)) AS active FROM cells GROUP BY 1, 2, 3")
def _(spark, d):
    return cb.any_active(b.cells(spark, d))


TILES = """, tg AS (SELECT month, c, ty, tx FROM (SELECT DISTINCT month FROM cells), (SELECT DISTINCT c FROM cells), range(7) a(ty), range(7) b(tx)),
t0 AS (SELECT month, c, ty, tx, sum(v) / 256.0::DOUBLE AS tile FROM cells, range(7) a(ty), range(7) b(tx) WHERE y BETWEEN ty * 8 AND ty * 8 + 15 AND x BETWEEN tx * 8 AND tx * 8 + 15 GROUP BY 1, 2, 3, 4),
t AS (SELECT tg.*, coalesce(tile, 0) AS tile FROM tg LEFT JOIN t0 USING (month, c, ty, tx))"""


@query("f06_tile_mean", C + TILES + " SELECT month, c, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(tile, 6) AS tile FROM t")
def _(spark, d):
    return cb.tile_mean(b.cells(spark, d), 64, 64, 16).withColumn("tile", R("tile"))


@query("f07_tile_vector", C + TILES + " SELECT month, count(*)::INTEGER AS n, round(sum(tile), 6) AS total, round(first(tile ORDER BY c, ty, tx), 6) AS first_tile FROM t GROUP BY 1")
def _(spark, d):
    v = cb.tile_vector(cb.tile_mean(b.cells(spark, d), 64, 64, 16))
    return v.select("month", F.size("vec").alias("n"), R(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"), R(F.col("vec")[0]).alias("first_tile"))


ST = {(dy, dx): (0.25 if dy == dx == 0 else 0.125 if 0 in (dy, dx) else 0.0625) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
STV = ", ".join(f"({a}, {x}, {w}::DOUBLE)" for (a, x), w in ST.items())


@query("f08_stencil", C + f""", s AS (SELECT month, c, y - dy AS y, x - dx AS x, v * w AS v FROM cells, (VALUES {STV}) k(dy, dx, w))
SELECT month, c, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(v), 6) AS v FROM s WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return cb.stencil3(b.cells(spark, d), 64, 64, ST).withColumn("v", R("v"))


@query("f09_active_stats", C + " SELECT c, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM cells WHERE v > 0 GROUP BY 1")
def _(spark, d):
    return cb.active_stats(b.cells(spark, d)).withColumns({"mean": R("mean"), "sd": R("sd")})


@query("f10_ping_density", """WITH p AS (SELECT event_type AS cls, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(floor(value / 25.0) AS INTEGER) AS cx, CAST(floor((event_id % 97) / 25.0) AS INTEGER) AS cy,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9::DOUBLE AS h FROM events)
SELECT month, cls, cy, cx, round(sum(least(h, 6)), 6) AS hours FROM p WHERE h IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    e = b.events(spark, d)
    p = e.select(F.col("station").alias("vessel"), "us", F.col("event_id").alias("ping_id"), b.month("ts").alias("month"),
                 F.col("event_type").alias("cls"), F.col("value").alias("x"), F.pmod("event_id", F.lit(97)).alias("y"))
    return cb.ping_density(p, 25.0, 6.0).withColumn("hours", R("hours"))


@query("o06_top_by_auprc", valid_sql(True) + metrics_sql(["entity"]) + f" SELECT entity, n, pos, {MET} FROM met ORDER BY met.auprc DESC, entity LIMIT 15")
def _(spark, d):
    m = mt.metric_table(b.preds(spark, d, True), ["entity"])
    return four(rs.top_by(m, "auprc", 15, "entity"))


@query("k04_coverage", "WITH " + b.DAILY_PANEL + """, n AS (SELECT count(DISTINCT day) AS m FROM dpanel)
SELECT station, count(DISTINCT day) AS months, count(stage) AS n_stage, CAST(count(stage) >= (SELECT m FROM n) AS INTEGER) AS complete FROM dpanel GROUP BY 1""")
def _(spark, d):
    return rs.coverage_list(b.daily_panel(spark, d), "station", "day", ["stage"])
