"""Label matrix: construction, audit, samples and neighbours (inventory J, D12-D15, B16-B19, O2-O4, A12, A13, A18).

A pair table holds the half triangle ``i_idx <= j_idx`` of a distance matrix over labels
``<entity>-<year>``.  Labels are a dimension (entities x years), far fewer than the facts they
were aggregated from; the facts themselves are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.scalars import STRIDE_STEP, stride_sample
from ..session import materialise
from .components import components, scores
from .patterns import global_index, only_row, quantiles, quantiles_wide
from .selection import first_counts, radix_quantiles


def impute_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Nulls take the column's median."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("value")) for c in cols])))
    med = quantiles_wide(long, ["var"], "value", {"med": 0.5}, exact)
    one = only_row(med, F.map_from_entries(F.collect_list(F.struct("var", "med"))).alias("m"))
    return df.withColumn("_m", one).withColumns({c: F.coalesce(F.col(c), F.col("_m.m")[c]) for c in cols}).drop("_m")


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Global z-score with the population deviation; a constant column becomes 0."""
    stats = only_row(df, *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    z = lambda c: (F.col(c) - F.col(f"_z.m_{c}")) / F.when(F.col(f"_z.s_{c}") > 0, F.col(f"_z.s_{c}")).otherwise(1.0)
    return df.withColumn("_z", stats).withColumns({c: z(c) for c in cols}).drop("_z")


def pca2(df: DataFrame, cols: Sequence[str] | str, k: int | None = 2) -> DataFrame:
    """First k principal components (all, if None) of the centred columns (or of one array column), ``pc1..pck``.

    Sign convention: the largest loading of a component is positive.
    """
    vector = F.col(cols) if isinstance(cols, str) else F.array(*cols)
    found = components(df, vector, k)
    out = scores(df, vector, found)
    return out if found.n else out.withColumns({f"pc{j + 1}": F.lit(None).cast("double") for j in range(k or 0)})


def index_labels(df: DataFrame, entity: str = "entity", year: str = "year") -> DataFrame:
    """0-based index of the labels ``<entity>-<year>`` in (entity, year) order."""
    d = df.withColumn("label", F.concat_ws("-", entity, year)).withColumn("_k", (F.col(entity) * 10000 + F.col(year)).cast("double"))
    return global_index(d, "_k", [entity, year], "idx").drop("_k")


def pairwise_distance(
    points: DataFrame, coords: Sequence[str], block: int = 256, i_where: Column | None = None, j_where: Column | None = None,
    same: Sequence[str] = (), stride: int = 1,
) -> DataFrame:
    """Euclidean distance of every label pair ``i_idx <= j_idx``.

    Labels are tiled into blocks and joined on the block pair, so every task computes at most
    block x block distances; the n(n+1)/2 rows are the result itself.  Selections are made on the
    points, before anything is paired: ``i_where`` and ``j_where`` keep the points of one side (B16,
    B19), ``same`` pairs only points that agree on these columns (D15, O4), and ``stride`` pairs a row
    only with the columns that the modular sample takes (B18).
    """
    top = only_row(points, F.floor(F.max("idx") / F.lit(block)).alias("b"))
    p = points.select("idx", "label", "entity", "year", *coords, *[F.col(c).alias(f"_s_{c}") for c in same])
    p = p.withColumn("_b", F.floor(F.col("idx") / F.lit(block))).withColumn("_t", top)
    keys = [f"_s_{c}" for c in same]
    side = lambda s, keep: (p if keep is None else p.where(keep)).select(*[F.col(c).alias(f"{s}_{c}") for c in ("idx", "label", "entity", "year", *coords)], *keys, "_b", "_t")
    left = side("i", i_where).withColumn("bi", F.col("_b")).withColumn("bj", F.explode(F.sequence(F.col("_b"), F.col("_t.b")))).drop("_b", "_t")
    right = side("j", j_where).withColumn("bj", F.col("_b")).withColumn("bi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b")))).drop("_b", "_t")
    if stride > 1:
        left = left.withColumn("_r", F.pmod(-F.col("i_idx") * STRIDE_STEP, F.lit(stride)))
        right = right.withColumn("_r", F.pmod("j_idx", F.lit(stride)))
        keys = [*keys, "_r"]
    sq = sum((F.pow(F.col(f"i_{c}") - F.col(f"j_{c}"), F.lit(2.0)) for c in coords), F.lit(0.0))
    j = left.join(right, ["bi", "bj", *keys]).where("i_idx <= j_idx")
    return j.select("i_idx", "j_idx", "i_label", "j_label", F.col("i_entity").alias("i_country"), F.col("j_entity").alias("j_country"),
                    "i_year", "j_year", F.sqrt(sq).alias("distance"))


def self_pairs(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """The diagonal, made from the points without pairing any."""
    sq = sum((F.pow(F.col(c) - F.col(c), F.lit(2.0)) for c in coords), F.lit(0.0))
    names = {"idx": "idx", "label": "label", "entity": "country", "year": "year"}
    return points.select(*[F.col(c).alias(f"{s}_{n}") for c, n in names.items() for s in ("i", "j")], F.sqrt(sq).alias("distance"))


def distances_from(points: DataFrame, coords: Sequence[str], node: str) -> DataFrame:
    """O2: distances of one labelled point to all others; the point is a one-row scalar, nothing is joined."""
    one = only_row(points.where(F.col("label") == node), *[F.first(c).alias(c) for c in coords])
    p = points.where(F.col("label") != node).withColumn("_one", one)
    sq = sum((F.pow(F.col(c) - F.col(f"_one.{c}"), F.lit(2.0)) for c in coords), F.lit(0.0))
    return p.select(F.lit(node).alias("node"), F.col("label").alias("other"), F.sqrt(sq).alias("distance")).where("distance IS NOT NULL")


def mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of every off-diagonal pair, as (node, other, ...) rows."""
    a = pairs.select(F.col("i_label").alias("node"), F.col("j_label").alias("other"), F.col("i_country").alias("country"), F.col("j_country").alias("other_country"),
                     F.col("i_year").alias("year"), F.col("j_year").alias("other_year"), "distance")
    b = pairs.where("i_idx <> j_idx").select(
        F.col("j_label").alias("node"), F.col("i_label").alias("other"), F.col("j_country").alias("country"), F.col("i_country").alias("other_country"),
        F.col("j_year").alias("year"), F.col("i_year").alias("other_year"), "distance")
    return a.unionByName(b)


# --- audit -------------------------------------------------------------------------------------

INF = math.inf


def audit_columns(eps: float) -> list[Column]:
    d = F.col("distance")
    diag, off = F.col("i_idx") == F.col("j_idx"), F.col("i_idx") != F.col("j_idx")
    nan = F.coalesce(F.isnan(d), F.lit(False)) | d.isNull()
    c = lambda cond, name: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0)).alias(name)
    return [
        F.count(F.lit(1)).alias("total"), c(diag, "diag"), c(nan, "nan"), c(~nan & (F.abs(d) == INF), "inf"), c(~nan & (d < 0), "neg"),
        c(diag & ~nan & (F.abs(d) > eps), "diag_nonzero"), c(diag & ~F.col("i_label").eqNullSafe(F.col("j_label")), "label_mismatch"),
        c(off & (d == 0), "off_zero"), c(off & ~nan & (F.abs(d) <= eps), "off_zero_eps"),
        c(off & (F.col("i_year") == F.col("j_year")), "same_year"), c(off & (F.col("i_year") != F.col("j_year")), "cross_year"),
    ]


def matrix_audit(pairs: DataFrame, eps: float = 1e-12, extra: Sequence[Column] = ()) -> DataFrame:
    """All counters in one aggregation; ``complete`` compares the rows with n(n+1)/2."""
    return complete_audit(pairs.agg(*audit_columns(eps), *extra))


def complete_audit(a: DataFrame) -> DataFrame:
    return a.withColumn("expected", (F.col("diag") * (F.col("diag") + 1) / 2).cast("bigint")).withColumn(
        "complete", (F.col("total") == F.col("expected")).cast("int"))


def moments(pairs: DataFrame) -> DataFrame:
    """Count, mean and population deviation off the diagonal."""
    return pairs.where("i_idx <> j_idx").agg(
        F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"))


QS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def quantile_profile(pairs: DataFrame, qs: Sequence[float] = QS, exact: bool = True) -> DataFrame:
    """Quantiles of off-diagonal distances overall, within and across years.

    Exact ones come from radix selection: ``pairs`` is scanned up to five times and should be stored.
    """
    both = off_diagonal(pairs).withColumn("part", F.explode(F.array(F.lit("all"), F.col("part"))))
    return radix_quantiles(both, ["part"], "distance", qs) if exact else quantiles(both, ["part"], "distance", qs, False)


def off_diagonal(pairs: DataFrame) -> DataFrame:
    same = F.when(F.col("i_year") == F.col("j_year"), "same").otherwise("cross")
    return pairs.where("i_idx <> j_idx").select(F.col("distance").cast("double").alias("distance"), same.alias("part"))


def audit_pairs(pairs: DataFrame, eps: float = 1e-12, qs: Sequence[float] = QS) -> DataFrame:
    """Counters, moments and quantiles as key/value rows from up to five scans of a stored matrix.

    The first scan counts by part (diagonal, same or cross year) and leading digit of the distance and
    makes the counters and moments of every such cell; the other scans follow the quantiles' digits.
    """
    d = F.col("distance").cast("double")
    part = F.when(F.col("i_idx") == F.col("j_idx"), "diag").when(F.col("i_year") == F.col("j_year"), "same").otherwise("cross")
    counters = audit_columns(eps)
    names = ["total", "diag", "nan", "inf", "neg", "diag_nonzero", "label_mismatch", "off_zero", "off_zero_eps", "same_year", "cross_year"]
    off = F.when(F.col("i_idx") != F.col("j_idx"), d)
    cells = first_counts(pairs.withColumn("part", part), ["part"], d, *counters, F.count(off).alias("_c"), F.avg(off).alias("_m"), F.var_pop(off).alias("_v"))
    cells = materialise(cells, "audit_cells")

    one = only_row(cells, (F.sum(F.col("_c") * F.col("_m")) / F.sum("_c")).alias("mean"))
    spread = F.sum(F.col("_c") * (F.col("_v") + F.pow(F.col("_m") - F.col("_one.mean"), F.lit(2.0)))) / F.sum("_c")
    sums = cells.withColumn("_one", one).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.max("_one.mean").alias("mean"), F.sqrt(spread).alias("std"))
    a = complete_audit(sums)
    kv = a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in a.columns])))

    hist = cells.where("part <> 'diag' AND d IS NOT NULL").select(F.explode(F.array(F.lit("all"), F.col("part"))).alias("part"), "d", "n")
    hist = hist.groupBy("part", "d").agg(F.sum("n").alias("n"))
    both = off_diagonal(pairs).withColumn("part", F.explode(F.array(F.lit("all"), F.col("part"))))
    q = radix_quantiles(both, ["part"], "distance", qs, hist)
    return kv.unionByName(q.select(F.format_string("%s_p%s", "part", (F.col("q") * 100).cast("int")).alias("key"), "value"))


def mean_same_period(pairs: DataFrame) -> DataFrame:
    """Mean distance of an entity to the others within each year (the half triangle is mirrored first)."""
    m = mirror(pairs).where("year = other_year AND node <> other")
    return m.groupBy("country", "year").agg(F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("n"))


def validate_matrix(a: DataFrame, b: DataFrame, tol: float, sample: int = 1) -> DataFrame:
    """Cells that differ by more than ``tol`` or are missing on one side."""
    keep = stride_sample("i_idx", "j_idx", sample)
    x, y = a.where(keep).select("i_idx", "j_idx", F.col("distance").alias("_a")), b.where(keep).select("i_idx", "j_idx", F.col("distance").alias("_b"))
    j = x.join(y, ["i_idx", "j_idx"], "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    c = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    return j.agg(F.count(F.lit(1)).alias("cells"), c(gap > tol).alias("off"), c(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"),
                 F.max(gap).alias("max_gap"))


# --- selections ----------------------------------------------------------------------------------


def matrix_window(i0: int, i1: int, j0: int, j1: int) -> Column:
    """B16."""
    return F.col("i_idx").between(i0, i1) & F.col("j_idx").between(j0, j1)


def diagonal() -> Column:
    """B17."""
    return F.col("i_idx") == F.col("j_idx")


def drop_self(pairs: DataFrame) -> DataFrame:
    """B17."""
    return pairs.where("i_idx <> j_idx")


def pair_lookup(pairs: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Distance of two (entity, year) nodes, whichever half of the matrix holds it."""
    at = lambda s, k: (F.col(f"{s}_country") == k[0]) & (F.col(f"{s}_year") == k[1])
    return pairs.where((at("i", a) & at("j", b)) | (at("i", b) & at("j", a)))


def knn_of(distances: DataFrame, k: int) -> DataFrame:
    """O2: the k nearest of the distances from one node (:func:`distances_from`)."""
    return distances.orderBy("distance", "other").limit(k).select("node", "other", "distance")


def knn_all(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of every node; at most k rows per node survive each task."""
    w = Window.partitionBy("node").orderBy("distance", "other")
    return mirror(drop_self(pairs)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("node", "other", "distance", "rank")


def closest_pairs(pairs: DataFrame, year: int, k: int) -> DataFrame:
    """The k closest distinct pairs within one year."""
    return drop_self(pairs).where((F.col("i_year") == year) & (F.col("j_year") == year)).orderBy("distance", "i_idx", "j_idx").limit(k).select(
        "i_label", "j_label", "distance")


# --- text export -----------------------------------------------------------------------------------


def export_lines(pairs: DataFrame, precision: int = 4, base: int = 0, labels: bool = True, max_lines: int | None = None) -> DataFrame:
    """One formatted line per cell, optionally only the first ``max_lines`` in (i, j) order."""
    text = F.format_string(f"(%d,%d) %.{precision}f", F.col("i_idx") + base, F.col("j_idx") + base, F.col("distance"))
    if labels:
        text = F.concat(text, F.format_string(" [%s vs %s]", "i_label", "j_label"))
    out = pairs.select("i_idx", "j_idx", text.alias("line"))
    return out if max_lines is None else out.orderBy("i_idx", "j_idx").limit(max_lines)


# Fixed values of the page layout: inches, points to the inch and the smallest line height are the defaults below.
A4_HEIGHT_IN = 11.69


def lines_per_column(page_height_in: float = 11.0, top_in: float = 0.35, bottom_in: float = 0.35, font_pt: float = 4.2, spacing: float = 1.0) -> int:
    """Lines that fit into one text column of a page (72 points to the inch, at least 3.8 points a line)."""
    return max(1, int((page_height_in - top_in - bottom_in) * 72.0 // max(3.8, font_pt * spacing)))


def paginate(lines: DataFrame, per_col: int, ncols: int, n: int | Column) -> DataFrame:
    """Page, column and row of every line in (i, j) order; ``n`` is the number of labels."""
    nn = n if isinstance(n, Column) else F.lit(n)
    keyed = lines.withColumn("_k", (F.col("i_idx") * nn + F.col("j_idx")).cast("double"))
    idx = global_index(keyed, "_k", ["i_idx", "j_idx"], "_pos").drop("_k")
    page = per_col * ncols
    return idx.withColumns({
        "page": F.floor(F.col("_pos") / F.lit(page)) + 1,
        "col": F.floor(F.pmod("_pos", F.lit(page)) / F.lit(per_col)) + 1,
        "row": F.pmod("_pos", F.lit(per_col)) + 1,
    }).drop("_pos")


def estimate_export(points: DataFrame, per_page: int, mode: str = "all", stride: int = 1, max_pages: int = 0, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Expected lines and pages of an export mode, with the cap warning; counted from the labels, not from pairs.

    ``window`` is (i0, i1, j0, j1), ends included; the cells of it that the half triangle holds count.
    """
    a = points.agg(F.count(F.lit(1)).alias("labels"))
    n = F.col("labels")
    rows = (n * (n + 1) / 2).cast("bigint")
    if mode == "window":
        i0, i1, j0, j1 = window
        ends = F.sequence(F.lit(max(0, i0)), F.least(F.lit(i1), n - 1).cast("int"))
        wide = lambda i: F.greatest(F.least(F.lit(j1), n - 1) - F.greatest(F.lit(j0), i) + 1, F.lit(0)).cast("bigint")
        lines = F.when(n > max(0, i0), F.aggregate(F.when(F.lit(i1 >= max(0, i0)), ends).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda acc, i: acc + wide(i))).otherwise(F.lit(0))
    else:
        lines = {"all": rows, "diagonal": n, "stride": F.greatest(F.floor(rows / F.lit(max(1, stride))), F.lit(1))}[mode]
    e = a.select("labels", lines.cast("bigint").alias("lines"))
    e = e.withColumn("pages", F.greatest(F.ceil(F.col("lines") / F.lit(per_page)), F.lit(1)))
    return e.withColumn("capped", (F.lit(max_pages > 0) & (F.col("pages") > max_pages)).cast("int"))


def guarded_export(pairs: DataFrame, mode: str = "stride", force_full: bool = False, **kw) -> DataFrame:
    """Refuse the export of the whole matrix unless it is forced."""
    if mode == "all" and not force_full:
        raise ValueError("a full export must be forced")
    return export_lines(pairs, **kw)


