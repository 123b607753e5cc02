"""Pivots, scalers, summaries and hierarchy totals (inventory D, O)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from .patterns import join_same, join_small, only_row, quantiles_wide


def pivot_mean(df: DataFrame, keys: Sequence[str], col: str, value: str, names: Sequence) -> DataFrame:
    """Long to wide, mean of duplicates; the listed names save the extra pass for them."""
    return df.groupBy(*keys).pivot(col, list(names)).agg(F.avg(value))


def melt_years(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns whose name starts with four digits become (year, value) rows, nulls dropped."""
    years = [c for c in df.columns if len(c) >= 4 and c[:4].isdigit()]
    long = df.unpivot(list(ids), years, "_y", "value")
    return long.select(*ids, F.substring("_y", 1, 4).cast("int").alias("year"), "value").where("value IS NOT NULL")


def screen_vars(df: DataFrame, var: str, value: str, cut: float) -> DataFrame:
    """D3: rows of the variables whose share of nulls is at most ``cut``."""
    keep = df.groupBy(var).agg(F.avg(F.col(value).isNull().cast("int")).alias("_na")).where(F.col("_na") <= cut)
    return df.join(keep, var, "left_semi")


class Scaler:
    """None, zscore, robust, minmax, log or pct on long (keys, var, value) data.

    ``fit`` returns the per-variable statistics as a table, ``transform`` joins them back;
    ``fit_filter`` limits the rows the statistics see.
    """

    MODES = ("none", "zscore", "robust", "minmax", "log", "pct")

    def __init__(self, mode: str = "robust", var: str = "var", value: str = "value", eps: float = 1e-6, exact: bool = True):
        if mode not in self.MODES:
            raise ValueError(mode)
        self.mode, self.var, self.value, self.eps, self.exact, self.stats = mode, var, value, eps, exact, None

    def fit(self, df: DataFrame, fit_filter: Column | None = None) -> "Scaler":
        src, v = (df if fit_filter is None else df.where(fit_filter)), F.col(self.value)
        if self.mode == "zscore":
            sd = F.stddev_samp(v)
            self.stats = src.groupBy(self.var).agg(F.avg(v).alias("_c"), F.when(sd == 0, 1.0).otherwise(sd).alias("_s"))
        elif self.mode == "robust":
            q = quantiles_wide(src, [self.var], self.value, {"_q1": 0.25, "_c": 0.5, "_q3": 0.75}, self.exact)
            iqr = F.col("_q3") - F.col("_q1")
            self.stats = q.select(self.var, "_c", (F.when(iqr == 0, 1.0).otherwise(iqr) + self.eps).alias("_s"))
        elif self.mode == "minmax":
            self.stats = src.groupBy(self.var).agg(F.min(v).alias("_c"), (F.max(v) - F.min(v) + self.eps).alias("_s"))
        return self

    def transform(self, df: DataFrame, by: Sequence[str] = (), order: str | None = None, out: str = "scaled") -> DataFrame:
        v = F.col(self.value)
        if self.stats is not None:
            j = join_small(df, self.stats, [self.var])
            return j.withColumn(out, (v - F.col("_c")) / F.col("_s")).drop("_c", "_s")
        if self.mode == "log":
            return df.withColumn(out, F.log1p(v))
        if self.mode == "pct":
            w = Window.partitionBy(*by, self.var).orderBy(order)
            return df.withColumn(out, F.coalesce(F.try_divide(v, F.lag(v).over(w)) - 1, F.lit(0.0)))
        return df.withColumn(out, v)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, missing, mean, population deviation, min and max per column in one pass."""
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts += [F.count(F.lit(1)).alias(f"{c}.n"), F.sum(x.isNull().cast("bigint")).alias(f"{c}.missing"), F.avg(x).alias(f"{c}.mean"),
                  F.stddev_pop(x).alias(f"{c}.sd"), F.min(x).alias(f"{c}.min"), F.max(x).alias(f"{c}.max")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}.{k}`").alias(k) for k in ("n", "missing", "mean", "sd", "min", "max")]) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def basin_mean(cells: DataFrame, weights: DataFrame, cell_keys: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Weighted mean of the cells of a basin; cells without a value carry no weight."""
    j = cells.join(weights, list(cell_keys)).where(F.col(value).isNotNull())
    return j.groupBy(*by).agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("basin_mean"))


def hierarchy(df: DataFrame, levels: Sequence[str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Totals of every level by rollup; ``depth`` = number of levels kept."""
    g = df.rollup(*levels).agg(F.sum(value).alias("total"), F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.bit_count("_g")
    return g.select(*levels, depth.cast("int").alias("depth"), "total")


def crosscheck(ours: DataFrame, published: DataFrame, by: Sequence[str], value: str, total: str, tol: float) -> DataFrame:
    """Our sums against published totals with the relative error."""
    s = ours.groupBy(*by).agg(F.sum(value).alias("ours"))
    j = join_same(published.select(*by, F.col(total).alias("published")), s, by, "left")
    err = F.try_divide(F.abs(F.coalesce("ours", F.lit(0.0)) - F.col("published")), F.abs("published"))
    return j.withColumn("rel_error", err).withColumn("ok", (err <= tol).cast("int"))


def missing_rate(grid: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Expected and observed periods on the completed calendar, and the missing share."""
    return grid.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count(value).alias("observed")).withColumn(
        "missing_rate", 1 - F.col("observed") / F.col("expected")
    )


def masked_loss(df: DataFrame, loss: Column, mask: str = "y_mask", horizon: str = "horizon", weights: Mapping[int, float] | None = None) -> DataFrame:
    """Sum of loss x mask x horizon weight over max(sum of mask, 1)."""
    lam = F.lit(1.0)
    for h, w in (weights or {}).items():
        lam = F.when(F.col(horizon) == h, F.lit(float(w))).otherwise(lam)
    return df.agg((F.sum(loss * F.col(mask) * lam) / F.greatest(F.sum(mask), F.lit(1))).alias("loss"))


def anomaly_vs_normal(df: DataFrame, normals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Standardised anomaly against a table of normals (mu, sd)."""
    return df.join(normals, list(keys), "left").withColumn("anomaly", F.try_divide(F.col(value) - F.col("mu"), F.col("sd")))


def command_kpis(df: DataFrame, by: Sequence[str], hours: Column) -> DataFrame:
    """False accepts per hour, false rejects, mean latency and correct-silence rate.

    Input: ``intended`` (0/1), ``executed`` (0/1), ``latency``.
    """
    i, e = F.col("intended") == 1, F.col("executed") == 1
    c = lambda cond: F.sum(cond.cast("bigint"))
    return df.groupBy(*by).agg(
        F.try_divide(c(~i & e), hours).alias("far_per_hour"), F.try_divide(c(i & ~e), c(i)).alias("frr"),
        F.avg(F.when(e, F.col("latency"))).alias("latency"), F.try_divide(c(~i & ~e), c(~i)).alias("correct_silence"),
    )


# --- sorting, limits and sets ------------------------------------------------------------------


def top_by(df: DataFrame, metric: str, n: int, tie: str) -> DataFrame:
    """The n best rows (each task keeps n rows, nothing is sorted as a whole)."""
    return df.orderBy(F.desc_nulls_last(metric), tie).limit(n)


def top_candidates(df: DataFrame, by: Sequence[str], score: str, n: int, tie: str) -> DataFrame:
    """The n best rows of every group; Spark keeps n rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in the given order, by aggregation (map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def set_op(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Concat, union, intersect or difference."""
    ops = {"concat": lambda: a.unionByName(b), "union": lambda: a.unionByName(b).distinct(),
           "intersect": lambda: a.intersect(b.select(*a.columns)), "difference": lambda: a.subtract(b.select(*a.columns))}
    return ops[kind]()


def coverage_list(df: DataFrame, entity: str, month: str, variables: Sequence[str]) -> DataFrame:
    """K4: observed cells per entity and whether every month and variable is there."""
    total = only_row(df, F.countDistinct(month).alias("m"))
    seen = df.groupBy(entity).agg(
        F.countDistinct(month).alias("months"), *[F.count(v).alias(f"n_{v}") for v in variables]
    ).withColumn("_t", total)
    full = F.col("months") == F.col("_t.m")
    for v in variables:
        full = full & (F.col(f"n_{v}") >= F.col("_t.m"))
    return seen.withColumn("complete", full.cast("int")).drop("_t")
