"""Joins, alignment and integrity (C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scalars import slug
from ..operators import dyadic as dy, joins as jn, splits as sp, timeseries as ts
from ..operators.patterns import only_row
from ..session import materialise, new_path
from ..sources.tables import write_parquet
from . import base as b
from .registry import load, query

R = lambda c, n=6: F.round(c, n)
SLUG = "trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')))"


@query("c01_resolve_entities", f"""WITH nm AS (
  SELECT n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION SELECT '*' || lower(n_name) || '!' FROM nation),
sl AS (SELECT name, CASE WHEN {SLUG.format('name')} = 'nation 7' THEN 'nation 8' ELSE {SLUG.format('name')} END AS slug FROM nm),
c1 AS (SELECT {SLUG.format('n_name')} AS slug, 'A' || n_nationkey AS code FROM nation WHERE n_regionkey < 3),
c2 AS (SELECT {SLUG.format('n_name')} AS slug, 'B' || n_nationkey AS code FROM nation WHERE n_regionkey BETWEEN 2 AND 3),
j AS (SELECT name, sl.slug, coalesce(c1.code, c2.code) AS code FROM sl LEFT JOIN c1 ON c1.slug = sl.slug LEFT JOIN c2 ON c2.slug = sl.slug),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY name, slug) AS rn FROM j WHERE code IS NOT NULL)
SELECT code, name, slug FROM r WHERE rn = 1""")
def _(spark, d):
    n = load(spark, d, "nation")
    named = lambda t, k: load(spark, d, t).select(F.col(k).alias("n_nationkey")).distinct().join(n, "n_nationkey").select(F.col("n_name").alias("name"))
    third = n.select(F.concat(F.lit("*"), F.lower("n_name"), F.lit("!")).alias("name"))
    codes = lambda p, lo, hi: n.where(F.col("n_regionkey").between(lo, hi)).select(
        slug("n_name", unicode=False).alias("slug"), F.concat(F.lit(p), F.col("n_nationkey")).alias("code"))
    lists = [named("customer", "c_nationkey"), named("supplier", "s_nationkey"), third]
    return jn.resolve_entities(lists, codes("A", 0, 2), codes("B", 2, 3), {"nation 7": "nation 8"})


@query("c02_map_code", "SELECT s_suppkey, s_name, r_name AS code FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey < 4")
def _(spark, d):
    codes = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_regionkey < 4")
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return jn.map_code(s, codes.withColumnRenamed("r_name", "code"), "n_nationkey", "code")


@query("c03_common_entities", """SELECT o_custkey AS entity FROM orders INTERSECT SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events""")
def _(spark, d):
    return jn.common_entities([
        load(spark, d, "orders").select(F.col("o_custkey").alias("entity")),
        load(spark, d, "customer").select(F.col("c_custkey").alias("entity")),
        load(spark, d, "events").select(F.col("user_id").alias("entity"))], "entity")


FLAGS = ("A", "N", "R")


def annual_sums(spark, d):
    """Quantity per nation, year and return flag, one column per flag.

    Lines are summed to one row per order before anything is shuffled, the join to the orders
    keeps that partitioning, and customers are joined to one row per customer and year.
    """
    at = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f.lower())
    again = [F.sum(f.lower()).alias(f.lower()) for f in FLAGS]
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*map(at, FLAGS))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    per_cust = li.join(o, "o_orderkey").groupBy("o_custkey", "year").agg(*again)
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    return per_cust.join(c, "o_custkey").groupBy("entity", "year").agg(*again)


def annual(spark, d):
    """The same in long form (entity, year, var, value)."""
    long = annual_sums(spark, d).unpivot(["entity", "year"], ["a", "n", "r"], "var", "value")
    return long.where("value IS NOT NULL").withColumn("var", F.upper("var"))


ANNUAL = """annual AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, l_returnflag AS var, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
awide AS (SELECT entity, year, avg(CASE WHEN var = 'A' THEN value END) AS a, avg(CASE WHEN var = 'N' THEN value END) AS n, avg(CASE WHEN var = 'R' THEN value END) AS r
          FROM annual GROUP BY 1, 2)"""


def annual_wide(spark, d):
    return materialise(annual_sums(spark, d), "annual")


@query("c05_replicate_annual", "WITH " + b.PANEL + ", " + ANNUAL + """
SELECT p.entity, p.month, a, n, r FROM panel p LEFT JOIN awide w ON w.entity = p.entity AND w.year = year(p.month) - 1""")
def _(spark, d):
    return jn.replicate_annual(annual_wide(spark, d), b.panel(spark, d).select("entity", "month"), ["entity"])


@query("c06_hconcat", "WITH " + b.PRICE + """,
ship AS (SELECT s_nationkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT coalesce(p.entity, s.entity) AS entity, coalesce(p.month, s.month) AS month, round(price, 6) AS price, round(qty, 6) AS qty
FROM price p FULL JOIN ship s ON s.entity = p.entity AND s.month = p.month""")
def _(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_suppkey", b.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    sup = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity"))
    ship = per.join(sup, "l_suppkey").groupBy("entity", "month").agg(F.sum("q").alias("qty"))
    out = jn.hconcat([b.nation_price(spark, d), ship], ["entity", "month"])
    return out.withColumns({"price": R("price"), "qty": R("qty")})


def samples(spark, d, horizons=(1, 3)):
    return sp.sample_index(b.panel(spark, d).select("entity", F.col("t").alias("t_end")), "entity", "t_end", horizons, 12, 1)


SAMPLES = """, samples AS (SELECT CAST(t - 12 AS INTEGER) AS win_idx, entity, h.h_idx, h.horizon, t AS t_end FROM panel, (VALUES (0, 1), (1, 3)) h(h_idx, horizon) WHERE t >= 12)"""


@query("c07_attach_labels", "WITH RECURSIVE " + b.onset_labels_sql() + SAMPLES + """
SELECT s.win_idx, s.entity, s.h_idx, s.t_end, s.horizon, y, m FROM samples s JOIN labels_h l ON l.entity = s.entity AND l.t = s.t_end AND l.horizon = s.horizon""")
def _(spark, d):
    lab = b.onset_labels(spark, d).select("entity", "t", F.col("horizon").alias("hz"), "y", "m")
    out = jn.attach_labels(samples(spark, d), lab).where("horizon = hz")
    return out.select("win_idx", "entity", "h_idx", "t_end", "horizon", "y", "m")


@query("c08_subset", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_custkey IN (1, 2, 3)")
def _(spark, d):
    keep = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return jn.subset(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keep, [1, 2, 3])


@query("c09_reindex", "SELECT c_custkey AS old_ord, c_name, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS new_ord FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("old_ord"), "c_name")
    return jn.reindex_entities(c, "old_ord")


@query("c10_continent", "SELECT c_custkey, c_nationkey AS code FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA'")
def _(spark, d):
    dim = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("code"), F.col("r_name").alias("continent"))
    return jn.in_continent("code", "AFRICA", dim, load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("code")))


@query("c11_availability", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem),
h AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag || l_linestatus AS code FROM lineitem),
w AS (SELECT month, code FROM m, (VALUES ('AF'), ('NO'), ('RF'), ('XX')) v(code))
SELECT w.month, w.code, CAST(h.code IS NOT NULL AS INTEGER) AS present FROM w LEFT JOIN h ON h.month = w.month AND h.code = w.code""")
def _(spark, d):
    cat = load(spark, d, "lineitem").select(b.month("l_shipdate").alias("month"), F.concat("l_returnflag", "l_linestatus").alias("code")).distinct()
    return jn.availability(cat, cat, ["AF", "NO", "RF", "XX"], "nan")


@query("c13_nearest_join", """WITH a AS (SELECT s_acctbal AS pos, min(s_suppkey) AS s FROM supplier GROUP BY 1),
p AS (SELECT c_custkey, c_acctbal, s, abs(c_acctbal - pos) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal - pos), 6), pos) AS rn FROM customer, a)
SELECT c_custkey, s AS nearest, round(dist, 4) AS distance FROM p WHERE rn = 1""")
def _(spark, d):
    obs = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("mile"))
    assets = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("mile"))
    return jn.nearest_join(obs, assets, "mile", "c_custkey", "s_suppkey").select("c_custkey", "nearest", R("distance", 4).alias("distance"))


ASOF = """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id AS station, r.event_id AS r_event_id, r.value AS r_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _asof(spark, d, tol=None):
    e = b.events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "station", "us")
    right = e.where("event_type = 'view'").select("event_id", "station", "us", "value")
    return jn.asof_join(left, right, ["station"], "us", "event_id", tol).select("event_id", "station", "r_event_id", "r_value")


@query("c14_asof_join", ASOF)
def _(spark, d):
    return _asof(spark, d)


@query("c14_asof_join_tolerance", ASOF.replace("r.event_id AS r_event_id, r.value AS r_value", "CASE WHEN l.ts - r.ts <= INTERVAL 12 HOUR THEN r.event_id END AS r_event_id, CASE WHEN l.ts - r.ts <= INTERVAL 12 HOUR THEN r.value END AS r_value"))
def _(spark, d):
    return _asof(spark, d, 12 * 3.6e9)


def notices(spark, d):
    """Notices: one per error event, active for 1 to 5 days on 10 miles around its station."""
    e = load(spark, d, "events").where("event_type = 'error'")
    day = F.col("ts").cast("date")
    return e.select("event_id", day.alias("start"), F.date_add(day, F.pmod("event_id", F.lit(5)).cast("int")).alias("end"),
                    (F.col("user_id") - 5).alias("lo"), (F.col("user_id") + 5).alias("hi"), "value")


NOTICES = """notices AS (SELECT event_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS e, user_id - 5 AS lo, user_id + 5 AS hi, value FROM events WHERE event_type = 'error')"""


@query("c15_interval_join", "WITH " + b.DAILY + ", " + NOTICES + """
SELECT station, day, count(*) AS active, round(max(value), 6) AS worst FROM daily JOIN notices ON day BETWEEN s AND e AND station BETWEEN lo AND hi GROUP BY 1, 2""")
def _(spark, d):
    axes = [dy.Axis("day", "start", "end"), dy.Axis("station", "lo", "hi", 10.0)]
    j = dy.interval_join(b.daily(spark, d).select("station", "day"), notices(spark, d), axes)
    return j.groupBy("station", "day").agg(F.count(F.lit(1)).alias("active"), R(F.max("value")).alias("worst"))


@query("c15_notices_in_force", """WITH n AS (SELECT epoch_us(ts) AS s, epoch_us(ts) + (event_id % 30) * 86400000000 AS e, user_id - 5 AS lo, user_id + 5 AS hi, value FROM events WHERE event_type = 'error')
SELECT o.event_id, count(*) AS active, round(max(n.value), 6) AS worst FROM events o JOIN n ON epoch_us(o.ts) BETWEEN s AND e AND o.user_id BETWEEN lo AND hi GROUP BY 1""")
def _(spark, d):
    """Notices of up to a month, in quarter hours, in force at every single reading."""
    e = b.events(spark, d)
    n = e.where("event_type = 'error'").select(F.col("us").alias("start"), (F.col("us") + F.pmod("event_id", F.lit(30)) * 86_400_000_000).alias("end"), (F.col("station") - 5).alias("lo"), (F.col("station") + 5).alias("hi"), "value")
    axes = [dy.Axis("us", "start", "end", 900e6), dy.Axis("station", "lo", "hi", 4.0)]
    j = dy.interval_join(e.select("event_id", "us", "station"), n, axes)
    return j.groupBy("event_id").agg(F.count(F.lit(1)).alias("active"), R(F.max("value")).alias("worst"))


@query("c16_multirate_align", """WITH w AS (SELECT user_id AS station, CAST(date_trunc('week', ts) AS DATE) AS wk, avg(value) AS weekly FROM events GROUP BY 1, 2),
m AS (SELECT user_id AS station, CAST(date_trunc('month', ts) AS DATE) AS mo, sum(value) AS monthly FROM events GROUP BY 1, 2)
SELECT w.station, wk AS week, round(weekly, 6) AS weekly, round(monthly, 6) AS monthly FROM w LEFT JOIN m ON m.station = w.station AND m.mo = CAST(date_trunc('month', wk) AS DATE)""")
def _(spark, d):
    e = b.events(spark, d)
    w = jn.align(e, ["station"], "ts", "WEEK", {"weekly": F.avg("value")}).withColumnRenamed("period", "week").withColumn("mo", F.trunc("week", "MM"))
    m = jn.align(e, ["station"], "ts", "MONTH", {"monthly": F.sum("value")}).withColumnRenamed("period", "mo")
    return w.join(m, ["station", "mo"], "left").select("station", "week", R("weekly").alias("weekly"), R("monthly").alias("monthly"))


CODE_BOOKS = {"view": ("supplier", "s_suppkey"), "purchase": ("customer", "c_custkey"), "click": ("part", "p_partkey"), "signup": ("nation", "n_nationkey"), "error": ("region", "r_regionkey")}


@query("c17_validate_codes", "WITH r AS (" + " UNION ALL ".join(f"SELECT CAST({c} AS BIGINT) AS code, '{s}' AS scheme FROM {t}" for s, (t, c) in CODE_BOOKS.items()) + """)
SELECT user_id AS code, event_type AS scheme, count(*) AS n_rows FROM events ANTI JOIN r ON r.code = user_id AND r.scheme = event_type GROUP BY 1, 2""")
def _(spark, d):
    facts = load(spark, d, "events").select(F.col("user_id").alias("code"), F.col("event_type").alias("scheme"))
    books = [load(spark, d, t).select(F.col(c).cast("bigint").alias("code"), F.lit(s).alias("scheme")) for s, (t, c) in CODE_BOOKS.items()]
    return jn.validate_codes(facts, reduce(lambda x, y: x.unionByName(y), books), "code", "scheme")


MICRO = """micro AS (SELECT c_nationkey AS entity, c_mktsegment AS segment, sum(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def micro(spark, d):
    per = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    return per.join(c, "o_custkey").groupBy("entity", "segment").agg(F.sum("s").alias("value"))


@query("c18_benchmark_to_total", "WITH " + MICRO + """, t AS (SELECT c_nationkey AS entity, sum(abs(c_acctbal)) AS total FROM customer GROUP BY 1),
s AS (SELECT entity, sum(value) AS s FROM micro GROUP BY 1)
SELECT m.entity, segment, round(value * (total / s), 4) AS scaled, round(total / s, 9) AS ratio FROM micro m JOIN t ON t.entity = m.entity JOIN s ON s.entity = m.entity""")
def _(spark, d):
    totals = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("entity")).agg(F.sum(F.abs("c_acctbal")).alias("total"))
    out = jn.benchmark_to_total(micro(spark, d), totals, ["entity"], "value", "total")
    return out.select("entity", "segment", R("scaled", 4).alias("scaled"), R("ratio", 9).alias("ratio"))


@query("c21_pair_predictions", "WITH " + b.preds_sql() + " SELECT sample, y_true, round(y_prob, 9) AS p_a, round(y_prob_b, 9) AS p_b FROM preds")
def _(spark, d):
    p = b.preds(spark, d)
    out = jn.pair_predictions(p, p.select("sample", "y_true", F.col("y_prob_b").alias("y_prob")), ["sample"])
    return out.select("sample", "y_true", R("p_a", 9).alias("p_a"), R("p_b", 9).alias("p_b"))


@query("c22_resolve_order", """WITH h AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS ord, c_custkey AS key FROM customer)
SELECT 'heuristic' AS source, ord, key FROM h UNION ALL SELECT 'stored', (SELECT CAST(count(*) AS INTEGER) FROM h) - 1 - ord, key FROM h
UNION ALL SELECT 'override', CAST(n_nationkey AS INTEGER), CAST(n_nationkey AS BIGINT) FROM nation""")
def _(spark, d):
    keys = load(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    heuristic = jn.resolve_order(None, "key", None, None, keys)
    # The stored order comes from a file: here the keys backwards.
    last = only_row(keys, F.count_distinct("key").cast("int").alias("n"))["n"] - 1
    path = new_path(spark, "order")
    write_parquet(heuristic.withColumn("ord", last - F.col("ord")), path)
    stored = jn.resolve_order(None, "key", None, spark.read.parquet(path), keys)
    nations = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_nationkey").cast("bigint").alias("key"))
    override = jn.resolve_order(25, "key", nations, stored, keys)
    named = lambda df, s: df.select(F.lit(s).alias("source"), "ord", "key")
    return named(heuristic, "heuristic").unionByName(named(stored, "stored")).unionByName(named(override, "override"))


@query("c23_integrity_report", "WITH " + b.PRICE + """, sp AS (SELECT min(month) AS lo FROM price),
o AS (SELECT entity, date_diff('month', (SELECT lo FROM sp), month) AS t FROM price),
c AS (SELECT entity, count(DISTINCT t) AS n, min(t) AS lo, max(t) AS hi FROM o GROUP BY 1),
s AS (SELECT entity, t + 2 AS t_end FROM o)
SELECT 'incomplete_calendar' AS "check", CAST(sum(CAST(n <> hi - lo + 1 AS INTEGER)) AS BIGINT) AS violations FROM c
UNION ALL SELECT 'ordinal_out_of_range', CAST(sum(CAST(t_end > (SELECT max(t) FROM o) AS INTEGER)) AS BIGINT) FROM s
UNION ALL SELECT 'orphan_samples', count(*) FROM s ANTI JOIN o ON o.entity = s.entity AND o.t = s.t_end""")
def _(spark, d):
    o = ts.month_ordinal(b.nation_price(spark, d)).select("entity", "t")
    return jn.integrity_report(o.select("entity", (F.col("t") + 2).alias("t_end")), o, "entity", "t")


@query("c24_assemble_samples", "WITH " + b.PANEL + ", " + ANNUAL + SAMPLES + """,
w AS (SELECT t - 12 AS win_idx, sum(s) OVER (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS total FROM (SELECT t, sum(price) AS s FROM panel GROUP BY 1)),
st AS (SELECT p.entity, p.t AS t_end, a FROM panel p LEFT JOIN awide w ON w.entity = p.entity AND w.year = year(p.month) - 1)
SELECT s.entity, s.t_end, s.h_idx, s.win_idx, round(total, 3) AS total, a FROM samples s JOIN w ON w.win_idx = s.win_idx LEFT JOIN st ON st.entity = s.entity AND st.t_end = s.t_end""")
def _(spark, d):
    p = b.panel(spark, d)
    monthly = p.groupBy("t").agg(F.sum("price").alias("s")).withColumn("g", F.lit(0))
    win = ts.windows(monthly, ["s"], ["g"], "t", 12, 1).select(
        (F.col("t_end") - 12).alias("win_idx"), F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["s"]).alias("total"))
    st = jn.replicate_annual(annual_wide(spark, d), p.select("entity", "month", F.col("t").alias("t_end")), ["entity"]).select("entity", "t_end", "a")
    out = jn.assemble_samples(samples(spark, d).drop("horizon"), win, st)
    return out.select("entity", "t_end", "h_idx", "win_idx", R("total", 3).alias("total"), "a")
