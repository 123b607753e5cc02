"""How the driver's tables stand in for the panel, prediction, cell and sensor inputs.

The Spark functions and the SQL fragments of the same name describe the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import surge, timeseries as ts
from ..operators.patterns import micros
from ..session import materialise
from .registry import load


def month(c):
    return F.trunc(F.col(c).cast("date"), "MM")


def nation_price(spark, d) -> DataFrame:
    """Monthly mean order value per customer nation.

    Orders are first reduced per customer and month, so a customer with a third of all orders
    enters the join with at most one row per month.
    """
    per_cust = load(spark, d, "orders").groupBy("o_custkey", month("o_orderdate").alias("month")).agg(
        F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n")
    )
    cust = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    j = per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
    # The panel feeds many branches; entities x months is all that is written.
    return materialise(j.groupBy("entity", "month").agg((F.sum("s") / F.sum("n")).alias("price")), "price")


def panel(spark, d) -> DataFrame:
    """entity, t, month, raw, price (forward filled) on the completed calendar."""
    p = ts.complete_months(nation_price(spark, d).withColumnRenamed("price", "raw"), ["entity"])
    return p.withColumn("price", ts.ffill("raw", "entity", "month"))


def scored(spark, d, gamma=0.6) -> DataFrame:
    return surge.ifpa_fixed(panel(spark, d), ["entity"], gamma=gamma, y0=1995, y1=1998)


def flagged(spark, d, thresholds=(1.0, 2.0)) -> DataFrame:
    return surge.flag_family(scored(spark, d), thresholds)


def onset_labels(spark, d, thresholds=(1.0,), horizons=(1, 3)) -> DataFrame:
    f = flagged(spark, d, thresholds)
    return surge.make_labels(f, ["entity", "thr"], "t", horizons, timing="onset", refractory=2, min_len=1)


PRICE = """price AS (
  SELECT c_nationkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

PANEL = PRICE + """,
span AS (SELECT min(month) AS lo, max(month) AS hi FROM price),
cal AS (SELECT entity, CAST(m AS DATE) AS month
        FROM (SELECT DISTINCT entity FROM price), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM span)),
panel0 AS (SELECT cal.entity, cal.month, CAST(date_diff('month', (SELECT lo FROM span), cal.month) AS INTEGER) AS t, p.price AS raw
           FROM cal LEFT JOIN price p ON p.entity = cal.entity AND p.month = cal.month),
panel AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY entity ORDER BY month ROWS UNBOUNDED PRECEDING) AS price FROM panel0)"""

GROWTH = PANEL + """,
growth AS (SELECT *, ln(price / lag(price, 3) OVER w) AS cq, ln(price / lag(price, 12) OVER w) AS ca
           FROM panel WINDOW w AS (PARTITION BY entity ORDER BY month))"""

SCORED = GROWTH + """,
bgrow AS (SELECT entity, month, ln(price / lag(price, 3) OVER w) AS cq, ln(price / lag(price, 12) OVER w) AS ca
          FROM panel WHERE year(month) BETWEEN 1995 AND 1998 WINDOW w AS (PARTITION BY entity ORDER BY month)),
base AS (SELECT entity, month(month) AS moy, avg(cq) AS mu_cq, stddev_pop(cq) AS sd_cq, avg(ca) AS mu_ca, stddev_pop(ca) AS sd_ca
         FROM bgrow GROUP BY 1, 2),
scored AS (SELECT g.*, 0.6::DOUBLE * ((cq - coalesce(mu_cq, 0)) / (CASE WHEN sd_cq > 1e-9 THEN sd_cq ELSE 1e-6 END))
                     + 0.4::DOUBLE * ((ca - coalesce(mu_ca, 0)) / (CASE WHEN sd_ca > 1e-9 THEN sd_ca ELSE 1e-6 END)) AS z
           FROM growth g LEFT JOIN base b ON b.entity = g.entity AND b.moy = month(g.month))"""


def flagged_sql(thresholds=(1.0, 2.0)) -> str:
    vals = ", ".join(f"({float(x)}::DOUBLE)" for x in thresholds)
    return SCORED + f""",
flagged AS (SELECT s.*, thr, CAST(z IS NOT NULL AS INTEGER) AS valid, CAST(coalesce(z >= thr, false) AS INTEGER) AS flag
            FROM scored s, (VALUES {vals}) v(thr))"""


def onset_sql(src="flagged", r=2) -> str:
    """Greedy refractory choice as a recursive walk over the ordered starts."""
    return f""",
sts AS (SELECT *, row_number() OVER (PARTITION BY entity, thr ORDER BY t) AS rn FROM (
          SELECT entity, thr, t, flag, coalesce(lag(flag) OVER (PARTITION BY entity, thr ORDER BY t), 0) AS pf FROM {src})
        WHERE flag = 1 AND pf = 0),
walk AS (SELECT entity, thr, rn, t, t AS last, true AS ok FROM sts WHERE rn = 1
         UNION ALL
         SELECT s.entity, s.thr, s.rn, s.t, CASE WHEN s.t - w.last > {r} THEN s.t ELSE w.last END, s.t - w.last > {r}
         FROM walk w JOIN sts s ON s.entity = w.entity AND s.thr = w.thr AND s.rn = w.rn + 1),
onsets AS (SELECT f.*, CAST(w.t IS NOT NULL AS INTEGER) AS onset
           FROM {src} f LEFT JOIN (SELECT * FROM walk WHERE ok) w ON w.entity = f.entity AND w.thr = f.thr AND w.t = f.t)"""


def labels_sql(src="onsets", flag="onset", horizons=(1, 3)) -> str:
    parts = []
    for h in horizons:
        w = f"(PARTITION BY entity, thr ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        parts.append(
            f"SELECT entity, thr, t, month, {h} AS horizon, CAST(m AS INTEGER) AS m, CAST(m AND f > 0 AS INTEGER) AS y FROM ("
            f"SELECT *, coalesce(count(*) OVER {w} = {h} AND min(valid) OVER {w} = 1, false) AS m, coalesce(max({flag}) OVER {w}, 0) AS f FROM {src})"
        )
    return ",\nlabels_h AS (" + " UNION ALL ".join(parts) + ")"


def onset_labels_sql(thresholds=(1.0,), horizons=(1, 3)) -> str:
    return flagged_sql(thresholds) + onset_sql() + labels_sql(horizons=horizons)


# --- predictions -------------------------------------------------------------------------


def preds(spark, d, with_entity=False) -> DataFrame:
    """Scored events in the shape every metric expects: keys, y_true, y_mask, y_prob.

    One row per order: outcome = urgent, score = a monotone transform of the price, validity =
    closed or open status, horizon spread over 1, 3, 5.
    """
    o = load(spark, d, "orders")
    out = o.select(
        F.col("o_orderkey").alias("sample"),
        month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("year"),
        F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("horizon"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_true"),
        (F.col("o_orderstatus") != "P").cast("int").alias("y_mask"),
        (F.col("o_totalprice") / (F.col("o_totalprice") + 250000)).alias("y_prob"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007).alias("y_prob_b"),
        F.when(F.year("o_orderdate") <= 1999, "train").when(F.year("o_orderdate") == 2000, "val").otherwise("test").alias("split"),
        "o_custkey",
    )
    if not with_entity:
        return out.drop("o_custkey")
    cust = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    return out.join(cust, "o_custkey").drop("o_custkey")


def preds_sql(with_entity=False) -> str:
    return f"""preds AS (
  SELECT o_orderkey AS sample, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST([1, 3, 5][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS INTEGER) AS horizon,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y_true, CAST(o_orderstatus <> 'P' AS INTEGER) AS y_mask,
         o_totalprice / (o_totalprice + 250000) AS y_prob,
         CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007 AS y_prob_b,
         CASE WHEN year(o_orderdate) <= 1999 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'val' ELSE 'test' END AS split
         {', c_nationkey AS entity' if with_entity else ''}
  FROM orders {'JOIN customer ON o_custkey = c_custkey' if with_entity else ''})"""


# --- cells ---------------------------------------------------------------------------------


def cells(spark, d) -> DataFrame:
    """Gridded monthly cells: sum of quantity per month, class and 64 x 64 position."""
    li = load(spark, d, "lineitem")
    return li.groupBy(
        month("l_shipdate").alias("month"), F.col("l_returnflag").alias("c"),
        F.pmod("l_partkey", F.lit(64)).cast("int").alias("y"), F.pmod("l_suppkey", F.lit(64)).cast("int").alias("x"),
    ).agg(F.sum("l_quantity").alias("v"))


CELLS = """cells AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS c, CAST(l_partkey % 64 AS INTEGER) AS y,
         CAST(l_suppkey % 64 AS INTEGER) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"""


# --- sensors ---------------------------------------------------------------------------------


def events(spark, d) -> DataFrame:
    """Sensor readings: station, timestamp, microseconds, kind, value."""
    e = load(spark, d, "events")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("station"), "event_type", "value", micros("ts").alias("us"), "props"
    )


def daily(spark, d) -> DataFrame:
    """Daily reading per station: pre-aggregated, so a station has at most one row per day."""
    return load(spark, d, "events").groupBy(F.col("user_id").alias("station"), F.col("ts").cast("date").alias("day")).agg(
        F.avg("value").alias("stage"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")
    )


def daily_panel(spark, d) -> DataFrame:
    return ts.complete_days(materialise(daily(spark, d), "daily"), ["station"])


DAILY = """daily AS (
  SELECT user_id AS station, CAST(ts AS DATE) AS day, avg(value) AS stage, max(value) AS peak, count(*) AS n FROM events GROUP BY 1, 2)"""

DAILY_PANEL = DAILY + """,
dspan AS (SELECT min(day) AS lo, max(day) AS hi FROM daily),
dcal AS (SELECT station, CAST(m AS DATE) AS day FROM (SELECT DISTINCT station FROM daily),
         (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS m FROM dspan)),
dpanel AS (SELECT c.station, c.day, CAST(date_diff('day', (SELECT lo FROM dspan), c.day) AS INTEGER) AS t, stage, peak, n
           FROM dcal c LEFT JOIN daily d ON d.station = c.station AND d.day = c.day)"""
