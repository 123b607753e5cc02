"""Label matrix and its audit (J, C12, D12-D15, O2-O4, B16-B19, A10, A12, A13, A16, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest as nn, pairs as pr
from ..operators.patterns import global_index, only_row
from ..session import materialise
from . import base as b
from .alignment import ANNUAL, annual_wide
from .registry import load, query

R = lambda c, n=6: F.round(c, n)

POINTS = ANNUAL + """,
zs AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(r) AS mr, stddev_pop(r) AS sr FROM awide),
points AS (SELECT entity, year, entity || '-' || year AS label, row_number() OVER (ORDER BY entity, year) - 1 AS idx, (coalesce(a, 0) - ma) / sa AS x, (coalesce(r, 0) - mr) / sr AS y FROM awide, zs)"""
PAIRS = "WITH " + POINTS + """,
pairs AS (SELECT i.idx AS i_idx, j.idx AS j_idx, i.label AS i_label, j.label AS j_label, i.entity AS i_country, j.entity AS j_country, i.year AS i_year, j.year AS j_year,
  round(sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2), 10) AS distance FROM points i JOIN points j ON i.idx <= j.idx),
mir AS (SELECT i_label AS node, j_label AS other, i_country AS country, i_year AS year, j_year AS other_year, distance FROM pairs
        UNION ALL SELECT j_label, i_label, j_country, j_year, i_year, distance FROM pairs WHERE i_idx <> j_idx)"""


def points(spark, d):
    """Labels nation-year with two standardised coordinates."""
    w = annual_wide(spark, d).na.fill(0.0, ["a", "r"]).select("entity", "year", F.col("a").alias("x"), F.col("r").alias("y"))
    return pr.index_labels(pr.standardise(w, ["x", "y"]))


def pairs(spark, d, **selection):
    p = pr.pairwise_distance(materialise(points(spark, d), "points"), ["x", "y"], block=64, **selection)
    return p.withColumn("distance", R("distance", 10))  # equal distances stay equal in every engine


def is_node(entity, year):
    return (F.col("entity") == entity) & (F.col("year") == year)


@query("j01_impute_median", "WITH " + b.DAILY_PANEL + """ SELECT station, day, round(coalesce(stage, (SELECT quantile_cont(stage, 0.5) FROM dpanel)), 6) AS stage,
  round(coalesce(peak, (SELECT quantile_cont(peak, 0.5) FROM dpanel)), 6) AS peak FROM dpanel""")
def _(spark, d):
    return pr.impute_median(b.daily_panel(spark, d).select("station", "day", "stage", "peak"), ["stage", "peak"]).withColumns({"stage": R("stage"), "peak": R("peak")})


@query("j02_standardise", "WITH " + POINTS + " SELECT label, round(x, 6) AS x, round(y, 6) AS y FROM points")
def _(spark, d):
    return points(spark, d).select("label", R("x").alias("x"), R("y").alias("y"))


@query("j03_pca")
def _(spark, d):
    return pr.pca2(load(spark, d, "embeddings"), "embedding").select("vec_id", "label", "pc1", "pc2")


SPECTRUM = """WITH good AS (SELECT row_number() OVER () AS id, embedding AS v FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
x AS (SELECT id, i, CAST(v[i] AS DOUBLE) AS v FROM good, range(1, 65) r(i)),
cov AS (SELECT a.i, b.i AS j, covar_pop(a.v, b.v) AS c FROM x a JOIN x b ON a.id = b.id GROUP BY 1, 2),
cube AS (SELECT sum(a.c * b.c * c.c) AS s FROM cov a JOIN cov b ON a.j = b.i JOIN cov c ON b.j = c.i AND c.j = a.i)
SELECT (SELECT count(*) FROM good) AS n, round((SELECT sum(c) FROM cov WHERE i = j), 9) AS variance, round((SELECT sum(c * c) FROM cov), 9) AS squares, round((SELECT s FROM cube), 9) AS cubes"""


@query("j03_spectrum", SPECTRUM)
def _(spark, d):
    """Variances of the scores on all components: their sums of powers are the traces of the covariance's powers."""
    e = pr.pca2(load(spark, d, "embeddings"), "embedding", None)
    pcs = [c for c in e.columns if c.startswith("pc")]
    v = e.agg(F.count("pc1").alias("n"), F.array(*[F.var_pop(c) for c in pcs]).alias("v"))
    power = lambda p: R(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(p))), 9)
    return v.select("n", power(1).alias("variance"), power(2).alias("squares"), power(3).alias("cubes"))


@query("j05_index_labels", "WITH " + POINTS + " SELECT idx, label, entity, year FROM points")
def _(spark, d):
    return points(spark, d).select("idx", "label", "entity", "year")


@query("j04_pairwise_distance", PAIRS + " SELECT i_idx, j_idx, i_label, j_label, round(distance, 6) AS distance FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("i_idx", "j_idx", "i_label", "j_label", R("distance").alias("distance"))


@query("j06_validate_matrix", PAIRS + """ SELECT count(*) AS cells, CAST(sum(CAST(abs(distance - round(distance, 4)) > 1e-3 AS INTEGER)) AS BIGINT) AS off, 0::BIGINT AS missing FROM pairs""")
def _(spark, d):
    p = materialise(pairs(spark, d), "pairs")  # the matrix is the product; it is read twice
    return pr.validate_matrix(p, p.withColumn("distance", R("distance", 4)), 1e-3).select("cells", "off", "missing")


AUDIT = PAIRS + """, a AS (SELECT count(*) AS total, sum(CAST(i_idx = j_idx AS BIGINT))::BIGINT AS diag, 0::BIGINT AS nan, 0::BIGINT AS inf, sum(CAST(distance < 0 AS BIGINT))::BIGINT AS neg,
  sum(CAST(i_idx = j_idx AND distance > 1e-12 AS BIGINT))::BIGINT AS diag_nonzero, sum(CAST(i_idx = j_idx AND i_label <> j_label AS BIGINT))::BIGINT AS label_mismatch,
  sum(CAST(i_idx <> j_idx AND distance = 0 AS BIGINT))::BIGINT AS off_zero, sum(CAST(i_idx <> j_idx AND distance <= 1e-12 AS BIGINT))::BIGINT AS off_zero_eps,
  sum(CAST(i_idx <> j_idx AND i_year = j_year AS BIGINT))::BIGINT AS same_year, sum(CAST(i_idx <> j_idx AND i_year <> j_year AS BIGINT))::BIGINT AS cross_year FROM pairs),
au AS (SELECT *, CAST(diag * (diag + 1) / 2 AS BIGINT) AS expected, CAST(total = CAST(diag * (diag + 1) / 2 AS BIGINT) AS INTEGER) AS complete FROM a)"""


@query("d12_matrix_audit", AUDIT + " SELECT * FROM au")
def _(spark, d):
    return pr.matrix_audit(pairs(spark, d))


@query("d13_moments", PAIRS + " SELECT count(distance) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS sd FROM pairs WHERE i_idx <> j_idx")
def _(spark, d):
    return pr.moments(pairs(spark, d)).withColumns({"mean": R("mean"), "sd": R("sd")})


QL = "[" + ", ".join(f"{q}" for q in pr.QS) + "]"


@query("d14_quantile_profile", PAIRS + f""", off AS (SELECT distance, 'all' AS part FROM pairs WHERE i_idx <> j_idx UNION ALL
  SELECT distance, CASE WHEN i_year = j_year THEN 'same' ELSE 'cross' END FROM pairs WHERE i_idx <> j_idx)
SELECT part, unnest({QL})::DOUBLE AS q, round(unnest(quantile_cont(distance, {QL})), 6) AS value, count(*) AS n FROM off GROUP BY part""")
def _(spark, d):
    return pr.quantile_profile(materialise(pairs(spark, d), "pairs")).withColumn("value", R("value"))


@query("d14_quantile_profile_sketch")
def _(spark, d):
    return pr.quantile_profile(pairs(spark, d), exact=False)


@query("d15_mean_same_period", PAIRS + " SELECT country, year, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM mir WHERE year = other_year AND node <> other GROUP BY 1, 2")
def _(spark, d):
    return pr.mean_same_period(pairs(spark, d, same=["year"])).withColumn("mean_distance", R("mean_distance"))


@query("j07_audit_report", AUDIT + f""", kv AS (UNPIVOT (SELECT * FROM au) ON COLUMNS(*) INTO NAME key VALUE value),
off AS (SELECT distance, 'all' AS part FROM pairs WHERE i_idx <> j_idx UNION ALL SELECT distance, CASE WHEN i_year = j_year THEN 'same' ELSE 'cross' END FROM pairs WHERE i_idx <> j_idx),
q AS (SELECT part, unnest({QL}) AS q, unnest(quantile_cont(distance, {QL})) AS value FROM off GROUP BY part)
SELECT key, value::DOUBLE AS value FROM kv UNION ALL SELECT 'mean', round(avg(distance), 6) FROM pairs WHERE i_idx <> j_idx
UNION ALL SELECT 'std', round(stddev_pop(distance), 6) FROM pairs WHERE i_idx <> j_idx UNION ALL SELECT part || '_p' || CAST(q * 100 AS INTEGER), round(value, 6) FROM q""")
def _(spark, d):
    return pr.audit_pairs(materialise(pairs(spark, d), "pairs")).withColumn("value", R("value"))


@query("b16_matrix_window", PAIRS + " SELECT i_idx, j_idx, round(distance, 6) AS distance FROM pairs WHERE i_idx BETWEEN 10 AND 30 AND j_idx BETWEEN 20 AND 60")
def _(spark, d):
    return pairs(spark, d, i_where=F.col("idx").between(10, 30), j_where=F.col("idx").between(20, 60)).where(pr.matrix_window(10, 30, 20, 60)).select("i_idx", "j_idx", R("distance").alias("distance"))


@query("b17_diagonal", PAIRS + " SELECT i_label, round(distance, 6) AS distance FROM pairs WHERE i_idx = j_idx")
def _(spark, d):
    return pr.self_pairs(points(spark, d), ["x", "y"]).where(pr.diagonal()).select("i_label", R("distance").alias("distance"))


@query("b18_stride_sample", PAIRS + " SELECT i_idx, j_idx, round(distance, 6) AS distance FROM pairs WHERE (i_idx * 1000003 + j_idx) % 7 = 0")
def _(spark, d):
    return pairs(spark, d, stride=7).where(pr.stride_sample("i_idx", "j_idx", 7)).select("i_idx", "j_idx", R("distance").alias("distance"))


@query("b19_pair_lookup", PAIRS + """ SELECT i_label, j_label, round(distance, 6) AS distance FROM pairs
WHERE (i_country = 9 AND i_year = 1998 AND j_country = 4 AND j_year = 1996) OR (i_country = 4 AND i_year = 1996 AND j_country = 9 AND j_year = 1998)""")
def _(spark, d):
    either = is_node(9, 1998) | is_node(4, 1996)
    return pr.pair_lookup(pairs(spark, d, i_where=either, j_where=either), (9, 1998), (4, 1996)).select("i_label", "j_label", R("distance").alias("distance"))


@query("o02_knn_of_node", PAIRS + " SELECT node, other, round(distance, 6) AS distance FROM mir WHERE node = '7-1997' AND other <> node ORDER BY mir.distance, other LIMIT 10")
def _(spark, d):
    return pr.knn_of(pr.distances_from(materialise(points(spark, d), "points"), ["x", "y"], "7-1997").withColumn("distance", R("distance", 10)), 10).withColumn("distance", R("distance"))


@query("o03_knn_all", PAIRS + """, k AS (SELECT node, other, distance, row_number() OVER (PARTITION BY node ORDER BY distance, other) AS rank FROM mir WHERE node <> other)
SELECT node, other, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def _(spark, d):
    return nn.nearest(points(spark, d), ["x", "y"], 5).withColumn("distance", R("distance"))


@query("o04_closest_pairs", PAIRS + " SELECT i_label, j_label, round(distance, 6) AS distance FROM pairs WHERE i_idx <> j_idx AND i_year = 1999 AND j_year = 1999 ORDER BY pairs.distance, i_idx, j_idx LIMIT 15")
def _(spark, d):
    return nn.closest(points(spark, d).where("year = 1999"), ["x", "y"], 15).withColumn("distance", R("distance"))


@query("a12_export_lines", PAIRS + " SELECT i_idx, j_idx, printf('(%d,%d) %.4f [%s vs %s]', i_idx + 1, j_idx + 1, distance, i_label, j_label) AS line FROM pairs")
def _(spark, d):
    return pr.export_lines(pairs(spark, d), precision=4, base=1)


@query("a13_paginate", PAIRS + """, r AS (SELECT i_idx, j_idx, row_number() OVER (ORDER BY i_idx, j_idx) - 1 AS p FROM pairs)
SELECT i_idx, j_idx, CAST(p // 880 + 1 AS BIGINT) AS page, CAST((p % 880) // 176 + 1 AS BIGINT) AS col, CAST(p % 176 + 1 AS BIGINT) AS "row" FROM r""")
def _(spark, d):
    p = pairs(spark, d)
    n = only_row(p.where("i_idx = j_idx"), F.count(F.lit(1)).alias("n"))
    per_col = pr.lines_per_column()
    out = pr.paginate(p.select("i_idx", "j_idx").withColumn("_n", n), per_col, 5, F.col("_n.n"))
    return out.select("i_idx", "j_idx", "page", "col", "row")


@query("a18_estimate_export", PAIRS + """, l AS (SELECT sum(CAST(i_idx = j_idx AS BIGINT))::BIGINT AS labels FROM pairs), e AS (SELECT labels, CAST(greatest(labels * (labels + 1) / 2 // 3, 1) AS BIGINT) AS lines FROM l)
SELECT labels, lines, CAST(greatest(ceil(lines / 880.0), 1) AS BIGINT) AS pages, CAST(ceil(lines / 880.0) > 4 AS INTEGER) AS capped FROM e""")
def _(spark, d):
    return pr.estimate_export(points(spark, d), 880, "stride", 3, 4)


@query("a18_estimate_window", PAIRS + " SELECT (SELECT count(*) FROM points) AS labels, count(*) AS lines, CAST(greatest(ceil(count(*) / 880.0), 1) AS BIGINT) AS pages, 0 AS capped FROM pairs WHERE i_idx BETWEEN 5 AND 400 AND j_idx BETWEEN 20 AND 60")
def _(spark, d):
    return pr.estimate_export(points(spark, d), 880, "window", window=(5, 400, 20, 60))


@query("a18_guarded_export", PAIRS + " SELECT i_idx, j_idx, printf('(%d,%d) %.4f', i_idx, j_idx, distance) AS line FROM pairs WHERE (i_idx * 1000003 + j_idx) % 5 = 0")
def _(spark, d):
    return pr.guarded_export(pairs(spark, d, stride=5), "stride", labels=False)


@query("c12_theta_self_join", PAIRS + " SELECT i_idx, count(*) AS partners, round(max(distance), 6) AS farthest FROM pairs GROUP BY 1")
def _(spark, d):
    return pairs(spark, d).groupBy("i_idx").agg(F.count(F.lit(1)).alias("partners"), R(F.max("distance")).alias("farthest"))


@query("e25_global_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return global_index(o, "o_totalprice", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")
