"""Daily, weekly, monthly pipeline, graph and hierarchy queries (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import calendar_columns
from ..operators import hierarchy as hi, metrics as mt, multirate as mr, splits as sp, timeseries as ts
from ..operators.patterns import only_row
from ..session import materialise
from . import base as b
from .alignment import MICRO, micro
from .evaluation import NAIVE, naive
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


@query("m01_multirate_features", "WITH " + b.DAILY + """,
r AS (SELECT *, avg(stage) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS m7 FROM daily),
w AS (SELECT station, CAST(date_trunc('week', day) AS DATE) AS week, avg(m7) AS level, sum(CAST(stage < 30 AS INTEGER)) AS low, count(stage) AS days FROM r GROUP BY 1, 2)
SELECT station, CAST(date_trunc('month', week) AS DATE) AS month, round(avg(level), 6) AS mean_level, round(min(level), 6) AS worst_week, CAST(sum(low) AS BIGINT) AS low_days, CAST(sum(days) AS BIGINT) AS days FROM w GROUP BY 1, 2""")
def _(spark, d):
    m = mr.multirate_features(b.daily(spark, d), "station", "day", "stage", 30.0)
    return m.withColumns({"mean_level": R("mean_level"), "worst_week": R("worst_week")})


@query("m02_sequence_samples", "WITH " + b.PANEL + """, s AS (SELECT entity, t, sum(price) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS o, count(*) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS no,
  sum(month(month)) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING) AS k, count(*) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nf,
  sum(price) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS f FROM panel)
SELECT entity, t, round(o + 1e-8, 6) AS observed, CAST(k AS BIGINT) AS known, round(f + 1e-8, 6) AS target FROM s WHERE no = 6 AND nf = 3""")
def _(spark, d):
    p = b.panel(spark, d).withColumn("moy", F.month("month").cast("bigint"))
    s = mr.seq_samples(p, ["entity"], "t", 6, 3, "moy", "price", "price")
    tot = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return s.select("entity", "t", R(tot("observed") + 1e-8, 6).alias("observed"), F.aggregate("known", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("known"), R(tot("target") + 1e-8, 6).alias("target"))


def trade_edges(spark, d):
    """Supplier nation to customer nation, weight = shipped quantity; each step pre-aggregated."""
    per = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("q"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    by_src = per.join(s, "l_suppkey").groupBy("l_orderkey", "src").agg(F.sum("q").alias("q"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    by_cust = by_src.join(o, "l_orderkey").groupBy("o_custkey", "src").agg(F.sum("q").alias("q"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    return materialise(by_cust.join(c, "o_custkey").groupBy("src", "dst").agg(F.sum("q").alias("w")), "edges")


EDGES = """edges AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
x0 AS (SELECT c_nationkey AS node, avg(c_acctbal) AS x FROM customer GROUP BY 1),
so AS (SELECT src, sum(w) AS d FROM edges GROUP BY 1), si AS (SELECT dst, sum(w) AS d FROM edges GROUP BY 1),
f1 AS (SELECT e.src AS node, sum(w / d * x) AS x FROM edges e JOIN so ON so.src = e.src JOIN x0 ON node = e.dst GROUP BY 1),
f2 AS (SELECT e.src AS node, sum(w / d * x) AS x FROM edges e JOIN so ON so.src = e.src JOIN f1 ON node = e.dst GROUP BY 1),
b1 AS (SELECT e.dst AS node, sum(w / d * x) AS x FROM edges e JOIN si ON si.dst = e.dst JOIN x0 ON node = e.src GROUP BY 1),
b2 AS (SELECT e.dst AS node, sum(w / d * x) AS x FROM edges e JOIN si ON si.dst = e.dst JOIN b1 ON node = e.src GROUP BY 1),
fw AS (SELECT node, 0 AS k, x FROM x0 UNION ALL SELECT node, 1, x FROM f1 UNION ALL SELECT node, 2, x FROM f2),
bw AS (SELECT node, 0 AS k, x FROM x0 UNION ALL SELECT node, 1, x FROM b1 UNION ALL SELECT node, 2, x FROM b2)"""


@query("m03_diffusion", "WITH " + EDGES + " SELECT coalesce(fw.node, bw.node) AS node, coalesce(fw.k, bw.k) AS k, round(fw.x, 6) AS forward, round(bw.x, 6) AS backward FROM fw FULL JOIN bw ON bw.node = fw.node AND bw.k = fw.k")
def _(spark, d):
    x = materialise(load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("x")), "nodes")
    return mr.diffuse(trade_edges(spark, d), x, 3).withColumns({"forward": R("forward"), "backward": R("backward")})


@query("m04_edges_from_order", """WITH n AS (SELECT s_nationkey AS river, s_suppkey AS dst, s_acctbal AS mile, lag(s_suppkey) OVER w AS src, lag(s_acctbal) OVER w AS up FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))
SELECT river, src, dst, round(up - mile, 4) AS miles FROM n WHERE src IS NOT NULL""")
def _(spark, d):
    n = load(spark, d, "supplier").select(F.col("s_nationkey").alias("river"), "s_suppkey", F.col("s_acctbal").alias("mile"))
    return mr.edges_from_order(n, ["river"], "s_suppkey", "mile").withColumn("miles", R("miles", 4))


REC = "WITH " + MICRO + """, bs AS (SELECT entity, segment, value, abs(value) / 1000 AS var FROM micro), pt AS (SELECT entity, sum(value) * 1.05 AS total, 200000.0::DOUBLE AS tv FROM bs GROUP BY 1),
gs AS (SELECT entity, sum(value) AS s, sum(var) AS v FROM bs GROUP BY 1)"""


def base_forecasts(spark, d):
    m = materialise(micro(spark, d), "micro").withColumn("var", F.abs("value") / 1000)
    t = m.groupBy("entity").agg((F.sum("value") * 1.05).alias("total"), F.lit(200000.0).alias("total_var"))
    return m, t


@query("m05_reconcile", REC + """ SELECT b.entity, segment, round(value + var / (tv + v) * (total - s), 4) AS reconciled FROM bs b JOIN pt ON pt.entity = b.entity JOIN gs ON gs.entity = b.entity""")
def _(spark, d):
    m, t = base_forecasts(spark, d)
    out = mr.reconcile(m.join(t, "entity"), ["entity"], "value", "var", "total", "total_var")
    return out.select("entity", "segment", R("reconciled", 4).alias("reconciled"))


TREE = "WITH " + MICRO + """, l3 AS (SELECT 'n' || entity || '-' || segment AS node, entity, n_regionkey AS region, value AS e, abs(value) / 1000 AS s, value FROM micro JOIN nation ON n_nationkey = entity),
a2 AS (SELECT entity, region, sum(e) AS se, sum(s) AS ss, sum(value) AS value FROM l3 GROUP BY 1, 2), l2 AS (SELECT *, ss / (ss + 200000) AS w, se + ss / (ss + 200000) * (value * 1.05 - se) AS e, 200000 * (ss / (ss + 200000)) AS s FROM a2),
a1 AS (SELECT region, sum(e) AS se, sum(s) AS ss, sum(value) AS value FROM l2 GROUP BY 1), l1 AS (SELECT *, se + ss / (ss + 500000) * (value * 0.97 - se) AS e, 500000 * (ss / (ss + 500000)) AS s FROM a1),
a0 AS (SELECT sum(e) AS se, sum(s) AS ss, sum(value) AS value FROM l1), l0 AS (SELECT *, se + ss / (ss + 1000000) * (value * 1.02 - se) AS x FROM a0),
x1 AS (SELECT l1.*, l1.e + l1.s / l0.ss * (l0.x - l0.se) AS x FROM l1, l0), x2 AS (SELECT l2.*, l2.e + l2.s / x1.ss * (x1.x - x1.se) AS x FROM l2 JOIN x1 USING (region)),
x3 AS (SELECT l3.node, l3.e + l3.s / x2.ss * (x2.x - x2.se) AS x FROM l3 JOIN x2 USING (entity))"""


@query("m05_reconcile_tree", TREE + """ SELECT 'total' AS node, round(x, 3) AS reconciled FROM l0 UNION ALL SELECT 'r' || region, round(x, 3) FROM x1
UNION ALL SELECT 'n' || entity, round(x, 3) FROM x2 UNION ALL SELECT node, round(x, 3) FROM x3""")
def _(spark, d):
    """Total, regions, nations and segments of a nation, each with a forecast and a variance of its own."""
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("region"))
    leaf = materialise(micro(spark, d).join(nation, "entity"), "micro")
    name = lambda c: F.concat(F.lit(c[0]), F.col(c[1]).cast("string"))
    row = lambda node, parent, level, value, var: [node.alias("node"), parent.alias("parent"), F.lit(level).alias("level"), value.alias("value"), var.alias("var")]
    nodes = leaf.select(*row(F.concat(name(("n", "entity")), F.lit("-"), F.col("segment")), name(("n", "entity")), 3, F.col("value"), F.abs("value") / 1000))
    for key, up, level, factor, var in ((("n", "entity"), name(("r", "region")), 2, 1.05, 200000.0), (("r", "region"), F.lit("total"), 1, 0.97, 500000.0)):
        s = leaf.groupBy(*{"entity": ["entity", "region"], "region": ["region"]}[key[1]]).agg(F.sum("value").alias("v"))
        nodes = nodes.unionByName(s.select(*row(name(key), up, level, F.col("v") * factor, F.lit(var))))
    top = leaf.agg(F.sum("value").alias("v")).select(*row(F.lit("total"), F.lit(None).cast("string"), 0, F.col("v") * 1.02, F.lit(1000000.0)))
    return hi.reconcile_tree(nodes.unionByName(top), 3).select("node", R("reconciled", 3).alias("reconciled"))


@query("m06_coherency", REC + " SELECT pt.entity, round(total, 4) AS total, round(s, 4) AS bottom, round(total - s, 4) AS gap FROM pt JOIN gs ON gs.entity = pt.entity WHERE abs(total - s) > 0.01 * greatest(abs(total), 1)")
def _(spark, d):
    m, t = base_forecasts(spark, d)
    return mr.coherency(m, t, ["entity"], "value", "total", 0.01).select("entity", *[R(c, 4).alias(c) for c in ("total", "bottom", "gap")])


@query("m07_stack_inverse_error", NAIVE + """, h AS (SELECT entity, avg((fc - price) ** 2) AS ef, avg((nv - price) ** 2) AS en FROM f WHERE t < 60 GROUP BY 1)
SELECT f.entity, t, round((fc / ef + nv / en) / (1 / ef + 1 / en), 4) AS stacked FROM f JOIN h ON h.entity = f.entity WHERE t >= 60""")
def _(spark, d):
    f = naive(spark, d)
    out = mr.stack_inverse_error(f.where("t < 60"), f.where("t >= 60"), ["fc", "nv"], "price", ["entity"])
    return out.select("entity", "t", R("stacked", 4).alias("stacked"))


@query("m07_stack_linear", NAIVE + """, h AS (SELECT fc AS a, nv AS b, price AS y FROM f WHERE fc IS NOT NULL AND nv IS NOT NULL AND t < 60),
c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM h),
w AS (SELECT (ay * bb - cy * ab) / (aa * bb - ab * ab) AS wa, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, * FROM c)
SELECT entity, t, round((my + wa * (fc - ma) + wb * (nv - mb)) / 1000, 3) AS stacked FROM f, w WHERE t >= 60 AND fc IS NOT NULL AND nv IS NOT NULL""")
def _(spark, d):
    f = naive(spark, d).where("fc IS NOT NULL AND nv IS NOT NULL")
    return mr.stack_linear(f.where("t < 60"), f.where("t >= 60"), ["fc", "nv"], "price").select("entity", "t", R(F.col("stacked") / 1000, 3).alias("stacked"))


@query("m08_propagate")
def _(spark, d):
    f = naive(spark, d).where("fc IS NOT NULL").withColumns({"lo": F.col("fc") * 0.8, "mid": F.col("fc"), "hi": F.col("fc") * 1.2, "year": F.year("month")})
    return mr.propagate(f, ["entity", "year"], ["entity", "t"], [(0.05, "lo"), (0.5, "mid"), (0.95, "hi")], 1000, (0.05, 0.5, 0.95), seed=5)


@query("m09_rolling_origin", "WITH " + b.DAILY_PANEL + """, o AS (SELECT unnest(generate_series(14, (SELECT max(t) FROM dpanel), 7)) AS origin),
r AS (SELECT origin, 'train' AS role, p.* FROM dpanel p, o WHERE t + 1 <= origin UNION ALL SELECT origin, 'val', p.* FROM dpanel p, o WHERE t + 1 <= origin AND t >= origin - 7 + 1
      UNION ALL SELECT origin, 'score', p.* FROM dpanel p, o WHERE t = origin)
SELECT CAST(origin AS INTEGER) AS origin, role, count(*) AS n, round(avg(stage), 6) AS mean_stage FROM r GROUP BY 1, 2""")
def _(spark, d):
    p = b.daily_panel(spark, d)
    top = only_row(p, F.max("t").alias("t"))
    wf = sp.walk_forward(p.withColumn("_top", top), F.col("_top.t"), 1, F.lit(14), 7, -1, 7, "t")
    return wf.groupBy("origin", "role").agg(F.count(F.lit(1)).alias("n"), R(F.avg("stage")).alias("mean_stage"))


@query("m10_shift_scenario", "WITH " + b.DAILY_PANEL + " SELECT station, t, round(CASE WHEN t >= 10 AND t < 17 THEN stage + 1 ELSE stage END, 6) AS stage FROM dpanel")
def _(spark, d):
    return mr.shift_scenario(b.daily_panel(spark, d), "stage", "t", 10, 7).select("station", "t", R("stage").alias("stage"))


@query("m10_block_ablation", NAIVE + """, a AS (SELECT entity, 'both' AS block, abs(price - (fc + nv) / 2) AS e FROM f UNION ALL SELECT entity, 'last', abs(price - fc) FROM f UNION ALL SELECT entity, 'season', abs(price - nv) FROM f),
m AS (SELECT entity, block, -avg(e) AS skill FROM a GROUP BY 1, 2)
SELECT entity, arg_max(block, skill) AS best, round(max(skill), 4) AS best_value, round(max(skill) - min(skill), 4) AS spread, count(*) AS configs FROM m GROUP BY 1""")
def _(spark, d):
    f = naive(spark, d)
    pick = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("fc")) for k, v in
                     (("both", (F.col("fc") + F.col("nv")) / 2), ("last", F.col("fc")), ("season", F.col("nv")))])
    m = f.select("entity", "price", F.inline(pick)).groupBy("entity", "block").agg((-F.avg(F.abs(F.col("price") - F.col("fc")))).alias("skill"))
    return mt.ablation_table(m, ["entity"], "block", "skill").withColumns({"best_value": R("best_value", 4), "spread": R("spread", 4)})


@query("m11_calendar", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month_no, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter_no,
  CAST(quarter(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_quarter, CAST(isodow(o_orderdate) AS INTEGER) AS iso_weekday, CAST(strftime(o_orderdate, '%m-%d') IN ('01-01', '07-04', '12-25') AS INTEGER) AS is_holiday FROM orders""")
def _(spark, d):
    cols = calendar_columns("o_orderdate", ["01-01", "07-04", "12-25"])
    return load(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in cols.items()])


@query("m12_seasonal_naive", NAIVE + " SELECT entity, t, round(nv, 6) AS forecast FROM f")
def _(spark, d):
    return b.panel(spark, d).select("entity", "t", R(ts.seasonal_naive("price", 12, "entity", "t")).alias("forecast"))


def pings(spark, d):
    e = b.events(spark, d)
    return e.select(F.col("station").alias("vessel"), "us", F.col("event_id").alias("ping_id"), F.date_trunc("WEEK", "ts").cast("date").alias("week"), F.col("value").alias("pos"))


@query("m13_call_features", """WITH l AS (SELECT user_id AS vessel, epoch_us(ts) AS us, event_id, CAST(date_trunc('week', ts) AS DATE) AS week, value AS pos, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pu FROM events),
s AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu > 12 * 3.6e9::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY vessel ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l),
c AS (SELECT vessel, sid, min(week) AS week, (max(us) - min(us)) / 3.6e9::DOUBLE AS dwell, count(*) AS reports, max(pos) - min(pos) AS span FROM s GROUP BY 1, 2)
SELECT vessel, week, count(*) AS calls, round(sum(dwell), 6) AS dwell_hours, CAST(sum(reports) AS BIGINT) AS reports, CAST(sum(CAST(dwell >= 6 AS INTEGER)) AS BIGINT) AS queued,
  round(avg(CASE WHEN dwell = 0 THEN NULL ELSE span / dwell END), 5) AS speed FROM c GROUP BY 1, 2""")
def _(spark, d):
    c = mr.call_features(pings(spark, d), 12 * 3.6e9, 6.0)
    return c.withColumns({"dwell_hours": R("dwell_hours"), "speed": R("speed", 5)})


@query("m14_episode_severity", """WITH e AS (SELECT event_id AS event, user_id AS mile, CAST(ts AS DATE) AS day, value AS severity FROM events WHERE event_type = 'error')
SELECT event, s_suppkey AS segment, day + CAST(floor((s_suppkey - mile) * 0.5) AS INTEGER) AS day, round(severity * (1 - (s_suppkey - mile) / 9.0::DOUBLE), 6) AS severity
FROM e JOIN supplier ON s_suppkey BETWEEN mile AND mile + 8""")
def _(spark, d):
    ev = load(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("event"), F.col("user_id").alias("mile"), F.col("ts").cast("date").alias("day"), F.col("value").alias("severity"), F.lit(8).alias("reach"))
    seg = load(spark, d, "supplier").select(F.col("s_suppkey").alias("segment"), F.col("s_suppkey").alias("mile_cell"), F.col("s_suppkey").alias("mile"))
    return mr.episode_severity(ev, seg, 0.5).withColumn("severity", R("severity"))


@query("m15_index_to_base", "WITH " + b.PANEL + ", bs AS (SELECT entity, avg(price) AS b FROM panel WHERE year(month) = 1996 GROUP BY 1) SELECT p.entity, t, round(100 * price / b, 6) AS index FROM panel p LEFT JOIN bs ON bs.entity = p.entity")
def _(spark, d):
    p = b.panel(spark, d)
    return mr.index_to_base(p, ["entity"], "price", F.year("month") == 1996).select("entity", "t", R("index").alias("index"))
