"""Readers and writers exercised on the driver's tables (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest as nn, pairs as pr, reshape as rs, surge
from ..session import new_path
from ..sources import tables as src
from . import base as b
from .alignment import ANNUAL, annual_wide
from .matrix import PAIRS, pairs, points
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


@query("a01_read_csv", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    path = new_path(spark, "csv")
    src.write_csv(load(spark, d, "customer"), path)
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    return src.read_csv(spark, path, schema, ["c_custkey", "c_nationkey", "c_acctbal"])


@query("a02_read_wide", "WITH " + ANNUAL + """, f AS (SELECT entity, year, a FROM awide WHERE a IS NOT NULL AND NOT (entity = 3 AND year = 1997))
SELECT CAST(entity AS VARCHAR) AS entity, year, round(a, 2) AS value FROM f""")
def _(spark, d):
    gap = (F.col("entity") == 3) & (F.col("year") == 1997)  # a cell that the table marks as missing
    w = annual_wide(spark, d).withColumn("a", F.when(~gap, F.col("a")))
    years = w.agg(F.array_sort(F.collect_set("year"))).first()[0]  # as many as the calendar has
    wide = rs.pivot_mean(w, ["entity"], "year", "a", years)
    wide = wide.select("entity", *[F.coalesce(F.col(str(y)).cast("string"), F.lit("..")).alias(str(y)) for y in years])
    path = new_path(spark, "wide")
    src.write_csv(wide, path)
    long = rs.melt_years(src.read_wide(spark, path, ["entity"], years), ["entity"])
    return long.select("entity", "year", R(F.col("value").try_cast("double"), 2).alias("value"))


@query("a03_read_codes", "SELECT DISTINCT upper(c_mktsegment) AS code FROM customer")
def _(spark, d):
    path = new_path(spark, "codes")
    load(spark, d, "customer").select(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")).alias("value")).write.text(path)
    return src.read_codes(spark, path)


@query("a04_codes_from_list", "SELECT DISTINCT upper(trim(unnest(string_split(p_name, ' ')))) AS code FROM part")
def _(spark, d):
    return src.codes_from_list(load(spark, d, "part"), "p_name", " ")


@query("a05_catalog", "SELECT lower(l_returnflag) || '09' AS code, strftime(l_shipdate, '%Y%m') AS yyyymm, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, 'v2' AS version FROM lineitem GROUP BY ALL")
def _(spark, d):
    # One folder per class and month, as raster files would arrive, delivered twice; the listing reads no content.
    path = new_path(spark, "cells")
    c = b.cells(spark, d).withColumn("part", F.concat("c", F.lit("09_"), F.date_format("month", "yyyyMM"))).select("part", "y", "x", "v").repartition("part")
    for version in ("v1", "v2"):
        c.write.partitionBy("part").parquet(f"{path}/{version}")
    files = src.catalog(spark, path, glob="*.parquet", folders=True)
    return files.select("code", "yyyymm", "month", F.regexp_extract("path", "/(v[12])/", 1).alias("version"))


@query("a06_crop_cells", "WITH " + b.CELLS + " SELECT month, c, y, x, v FROM cells WHERE x BETWEEN 8 AND 24 AND y BETWEEN 10 AND 40")
def _(spark, d):
    return src.crop(b.cells(spark, d), 8, 24, 10, 40)


@query("a07_parquet_partitioned", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    t = src.write_parquet(o.repartition("year", F.pmod(F.xxhash64("o_orderkey"), F.lit(8))), new_path(spark, "orders"), ["year"])
    return t.where("year >= 1998").groupBy("year").agg(F.count(F.lit(1)).alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("a08_csv_sink", "WITH RECURSIVE " + b.onset_labels_sql() + """ SELECT horizon, CAST(year(month) AS INTEGER) AS year, CAST(sum(m) AS BIGINT) AS valid, CAST(sum(y * m) AS BIGINT) AS positives
FROM labels_h GROUP BY 1, 2""")
def _(spark, d):
    s = surge.label_stats(b.onset_labels(spark, d).withColumn("year", F.year("month")), ["horizon", "year"])
    path = new_path(spark, "label-stats")
    src.write_csv(s, path)
    return src.read_csv(spark, path, "horizon INT, year INT, valid BIGINT, positives BIGINT, pos_rate DOUBLE", ["horizon", "year", "valid", "positives"])


@query("a09_metadata", "WITH " + b.PANEL + """ SELECT CAST(max(t) + 1 AS BIGINT) AS periods, strftime(min(month), '%Y%m') AS first, strftime(max(month), '%Y%m') AS last,
  count(DISTINCT entity) AS entities, 12 AS window_len, 'robust' AS scaler FROM panel""")
def _(spark, d):
    m = b.panel(spark, d).agg(
        (F.max("t") + 1).alias("periods"), F.date_format(F.min("month"), "yyyyMM").alias("first"), F.date_format(F.max("month"), "yyyyMM").alias("last"),
        F.countDistinct("entity").alias("entities"), F.lit(12).alias("window_len"))
    path = new_path(spark, "meta")
    src.write_meta(m, path)
    schema = "periods BIGINT, first STRING, last STRING, entities BIGINT, window_len INT, scaler STRING"
    return src.read_meta(spark, path, schema, {"scaler": "robust"})


@query("a10_scan_pairs", PAIRS + " SELECT i_idx, round(avg(distance), 6) AS mean_distance FROM pairs GROUP BY 1")
def _(spark, d):
    path = new_path(spark, "pairs")
    src.write_parquet(pairs(spark, d), path)
    return src.scan_pairs(spark, path, ["i_idx", "distance"]).groupBy("i_idx").agg(R(F.avg("distance")).alias("mean_distance"))


@query("a11_report_text", """WITH s AS (SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, sum(CAST(o_orderstatus = 'P' AS BIGINT))::BIGINT AS pending FROM orders)
SELECT 'n_rows=' || n_rows AS value FROM s UNION ALL SELECT 'customers=' || customers FROM s UNION ALL SELECT 'pending=' || pending FROM s""")
def _(spark, d):
    s = load(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("customers"),
                                     F.sum((F.col("o_orderstatus") == "P").cast("bigint")).alias("pending"))
    path = new_path(spark, "report")
    src.write_report(s, path)
    return spark.read.text(path)


@query("a14_medallion", "SELECT event_id, user_id, value, 'events' AS _source, 'open' AS _licence FROM events")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "value")
    bronze = src.land(e, "events", "open", new_path(spark, "lake"))
    return src.refine(bronze, ["event_id"]).drop("_retrieved")


@query("a15_stream_source", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    from ..streaming.run import replay

    s = src.stream_files(spark, src.table_path(d, "events"), load(spark, d, "events").schema)
    return replay(s).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 4).alias("total"))


@query("a15_polled_source", "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    """The events polled by the hour, five days of polls in a micro-batch."""
    from ..sources.polls import stream_polls
    from ..streaming.run import replay

    s = stream_polls(spark, f"{d}/events.parquet", load(spark, d, "events").schema, "ts", 3600, polls=120)
    t = replay(s, polled=True).withColumn("day_us", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))))
    return t.groupBy("day_us", "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 4).alias("total"))


@query("a16_export_topk", PAIRS + """, k AS (SELECT node, other, distance, row_number() OVER (PARTITION BY node ORDER BY distance, other) AS rank FROM mir WHERE node <> other)
SELECT node, other, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def _(spark, d):
    path = new_path(spark, "topk")
    src.export_topk(nn.nearest(points(spark, d), ["x", "y"], 3).withColumn("distance", R("distance")), path)
    return src.read_csv(spark, path, "node STRING, other STRING, distance DOUBLE, rank INT")


@query("a17_manifest")
def _(spark, d):
    path = new_path(spark, "run")
    s = surge.label_stats(b.onset_labels(spark, d), ["horizon"])
    src.write_csv(s.repartition(1), f"{path}/label_stats")
    src.write_report(s.agg(F.sum("valid").alias("valid")), f"{path}/report")
    return src.manifest(spark, path, {"gamma": 0.6, "thr": 1.0, "horizons": [1, 3]})


@query("a17_fingerprint")
def _(spark, d):
    t = src.fingerprint(load(spark, d, "orders"), "orders")
    for name in ("customer", "lineitem", "events"):
        t = t.unionByName(src.fingerprint(load(spark, d, name), name))
    return t
