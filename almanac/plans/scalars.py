"""Scalar functions on the driver's tables (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import timeseries as ts
from . import base as b
from .registry import load, query

R = lambda c, n=6: F.round(c, n)

# The marks of a decomposed letter are not alphanumeric, hence a space follows the base letter.
ACCENTS = {"e": "éèêÉÈÊ", "o": "óöÓÖ", "n": "ñÑ", "c": "çÇ", "u": "üÜ", "a": "äÄ", "i": "íÍ"}
TXT = "text"
for _base, _set in ACCENTS.items():
    TXT = f"regexp_replace({TXT}, '[{_set}]', '{_base} ', 'g')"


@query("b01_slug", f"SELECT doc_id, md5(trim(lower(regexp_replace({TXT}, '[^A-Za-z0-9]+', ' ', 'g')))) AS slug_md5 FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(sc.slug("text")).alias("slug_md5"))


@query("b02_month_number", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month_no FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", sc.month_num(F.date_format("o_orderdate", "MMMM")).alias("month_no"))


@query("b03_make_month", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS parsed FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", sc.mk_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("month"), sc.parse_yyyymm(F.date_format("o_orderdate", "yyyyMM")).alias("parsed"))


@query("b04_clean_num", """SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
  CASE WHEN value >= 100 THEN NULL ELSE value END AS finite FROM events""")
def _(spark, d):
    inf = F.when(F.col("value") >= 100, F.lit(float("inf"))).otherwise(F.col("value"))
    return load(spark, d, "events").select(
        "event_id", sc.clean_num(F.get_json_object("props", "$.k")).alias("k"), sc.clean_num("event_type").alias("bad"), sc.clean_num(inf).alias("finite"))


@query("b05_filters", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, d):
    o = load(spark, d, "orders")
    return o.where(F.col("o_orderdate").between("1996-01-01", "1998-12-31 23:59:59") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("b06_not_flag", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem WHERE nullif(l_returnflag, 'N') IS DISTINCT FROM 'R'")
def _(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return li.where(sc.not_flag("flag", "R"))


@query("b07_var_name", "SELECT p_partkey, substr(p_type, 1, 1) || '_' || split_part(p_name, ' ', 1) AS var FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", sc.var_name("p_type", "p_name").alias("var"))


@query("b08_alias", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", sc.alias_values("o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"}).alias("priority"))


@query("b09_normalise", "SELECT l_orderkey, l_linenumber, round(ln(1 + least(greatest(l_quantity, 0), 40) / (1.0::DOUBLE * day(last_day(l_shipdate)))), 8) AS v FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(sc.normalise("l_quantity", "l_shipdate", 40.0, 1.0), 8).alias("v"))


@query("b10_masks", "WITH " + b.DAILY_PANEL + " SELECT station, t, CAST(stage IS NULL AS TINYINT) AS land, CAST(coalesce(stage = 0, false) AS TINYINT) AS quiet, CAST(coalesce(stage > 0, false) AS TINYINT) AS active FROM dpanel")
def _(spark, d):
    return b.daily_panel(spark, d).select("station", "t", *[c.alias(k) for k, c in sc.masks("stage").items()])


@query("b11_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 8) AS v FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", R(sc.signed_log1p("c_acctbal"), 8).alias("v"))


@query("b12_mask_and_fill", "WITH " + b.DAILY_PANEL + " SELECT station, t, round(coalesce(stage, -999), 6) AS stage, CAST(stage IS NULL AS TINYINT) AS stage_missing FROM dpanel")
def _(spark, d):
    return b.daily_panel(spark, d).select("station", "t", *sc.mask_and_fill(["stage"], -999.0)).withColumn("stage", R("stage"))


@query("b13_month_encoding", """SELECT o_orderkey, round(sin(2 * pi() * (month(o_orderdate) - 1) / 12), 8) + 0::DOUBLE AS s, round(cos(2 * pi() * (month(o_orderdate) - 1) / 12), 8) + 0::DOUBLE AS c,
  CAST(month(o_orderdate) AS INTEGER) AS hot, 12 AS size FROM orders""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", sc.month_enc("o_orderdate").alias("e"), sc.month_enc("o_orderdate", "onehot").alias("h"))
    return o.select("o_orderkey", R(F.col("e")[0], 8).alias("s"), R(F.col("e")[1], 8).alias("c"), F.array_position("h", F.lit(1.0)).cast("int").alias("hot"), F.size("h").alias("size"))


@query("b14_gate", "WITH " + b.DAILY_PANEL + """ SELECT station, t, round(coalesce(stage, 0), 6) AS g0, round(coalesce(peak, 0), 6) AS g1, CAST(stage IS NULL AS DOUBLE) AS m0, CAST(peak IS NULL AS DOUBLE) AS m1,
  round(cos(2 * pi() * (month(day) - 1) / 12), 8) AS c, 6 AS size FROM dpanel""")
def _(spark, d):
    p = b.daily_panel(spark, d)
    miss = F.array(F.col("stage").isNull().cast("double"), F.col("peak").isNull().cast("double"))
    g = p.select("station", "t", sc.gate(F.array("stage", "peak"), miss, sc.month_enc("day")).alias("g"))
    at = lambda i: F.col("g")[i]
    return g.select("station", "t", R(at(0)).alias("g0"), R(at(1)).alias("g1"), at(2).alias("m0"), at(3).alias("m1"), R(at(5), 8).alias("c"), F.size("g").alias("size"))


@query("b15_logit_sigmoid", "WITH " + b.preds_sql() + " SELECT sample, round(ln(y_prob / (1 - y_prob)), 8) AS z, round(1 / (1 + exp(-ln(y_prob / (1 - y_prob)))), 8) AS p FROM preds")
def _(spark, d):
    z = sc.logit("y_prob")
    return b.preds(spark, d).select("sample", R(z, 8).alias("z"), R(sc.sigmoid(z), 8).alias("p"))


@query("b20_label_key", "WITH RECURSIVE " + b.onset_labels_sql((1.0, 1.8, 2.0), (1, 3)) + " SELECT 'Y_' || horizon || '_thr' || CASE thr WHEN 1.0 THEN '1' WHEN 2.0 THEN '2' ELSE '1.8' END AS label, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM labels_h GROUP BY 1")
def _(spark, d):
    lab = b.onset_labels(spark, d, (1.0, 1.8, 2.0), (1, 3))
    names = F.create_map(*[F.lit(x) for h in (1, 3) for t in (1.0, 1.8, 2.0) for x in (f"{h}|{t}", sc.label_key(h, t))])
    key = names[F.concat_ws("|", "horizon", F.col("thr").cast("string"))]
    return lab.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))


@query("b21_projection", "SELECT c_custkey AS entity, c_acctbal AS balance FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").drop("c_name", "c_mktsegment").withColumnsRenamed({"c_custkey": "entity", "c_acctbal": "balance"})
    return c.select("entity", "balance")


@query("b22_clearance", "WITH " + b.DAILY_PANEL + """, c AS (SELECT station, t, 153 - stage AS clearance, CAST(153 - stage < 120 AS INTEGER) AS low FROM dpanel)
SELECT station, t, round(clearance, 6) AS clearance, CAST(coalesce(low <> lag(low) OVER (PARTITION BY station ORDER BY t), false) AS INTEGER) AS crossing FROM c""")
def _(spark, d):
    p = b.daily_panel(spark, d).withColumn("clearance", sc.clearance(F.lit(153.0), "stage"))
    p = p.withColumn("low", (F.col("clearance") < 120).cast("int"))
    cross = F.coalesce(F.col("low") != F.lag("low").over(ts.over("station", "t")), F.lit(False)).cast("int")
    return p.select("station", "t", R("clearance").alias("clearance"), cross.alias("crossing"))


@query("b23_datum", "SELECT event_id, round(value + s_acctbal / 1000, 6) AS stage FROM events JOIN supplier ON s_suppkey = user_id")
def _(spark, d):
    off = load(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") / 1000).alias("datum"))
    return load(spark, d, "events").join(off, "user_id").select("event_id", R(F.col("value") + F.col("datum")).alias("stage"))


KINDS = ["one-way traffic at mile 10 to 20", "tow size limit 36 in force", "channel closed from mile 5.5", "high water advisory", "closure with one way traffic, miles 100 - 120.5"]


def notice_text():
    """A notice sentence per event, its wording chosen by the event's own numbers."""
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("event_id", F.lit(len(KINDS))) + 1).cast("int"))


@query("b24_parse_notice", """SELECT event_id, CAST(event_id % 5 IN (0, 4) AS INTEGER) AS one_way, CAST(event_id % 5 = 1 AS INTEGER) AS tow_limit, CAST(event_id % 5 IN (2, 4) AS INTEGER) AS closure,
  CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 5 END AS intensity,
  CASE event_id % 5 WHEN 0 THEN 10.0::DOUBLE WHEN 2 THEN 5.5 WHEN 4 THEN 100 END AS mile_lo, CASE event_id % 5 WHEN 0 THEN 20.0::DOUBLE WHEN 2 THEN 5.5 WHEN 4 THEN 120.5 END AS mile_hi FROM events""")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", notice_text().alias("notice"))
    return e.select("event_id", *[c.alias(k) for k, c in sc.parse_notice("notice").items()])


@query("b25_theta", """SELECT event_id, round(0.2 + 0.02 * length(event_type) + 0.3 * (value / (value + 50)) + 0.5 * (10 / value) + 0.1 * (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 8) AS theta FROM events""")
def _(spark, d):
    th = sc.theta(F.length("event_type"), F.col("value") / (F.col("value") + 50), F.col("value") / 10, (F.col("event_type") == "error").cast("int"))
    return load(spark, d, "events").select("event_id", R(th, 8).alias("theta"))


@query("b26_losses", "WITH " + b.preds_sql() + """ SELECT sample, round(-2 * (y_true * ln(y_prob) + (1 - y_true) * ln(1 - y_prob)), 8) AS bce,
  round(-(CASE WHEN y_true = 1 THEN 0.25 ELSE 0.75 END) * (CASE WHEN y_true = 1 THEN 1 - y_prob ELSE y_prob END) ** 2 * ln(CASE WHEN y_true = 1 THEN y_prob ELSE 1 - y_prob END), 8) AS focal FROM preds""")
def _(spark, d):
    return b.preds(spark, d).select("sample", R(sc.bce("y_true", "y_prob", 2.0), 8).alias("bce"), R(sc.focal("y_true", "y_prob"), 8).alias("focal"))


@query("b27_pinball", "SELECT o_orderkey, round(greatest(0.9::DOUBLE * (o_totalprice - 250000), (0.9::DOUBLE - 1) * (o_totalprice - 250000)), 5) AS loss FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", R(sc.pinball("o_totalprice", F.lit(250000.0), 0.9), 5).alias("loss"))
