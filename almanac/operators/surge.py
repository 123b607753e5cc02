"""Surge detectors and horizon labels (inventory E3-E13, D5, D6).

A detector adds ``z`` (or its excess over a cut) and ``valid``; flags, episodes and labels
are derived by the shared steps, and a family of thresholds reuses one score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window

from .timeseries import label_exact, label_window, log_growth, min_duration, onsets, over, pct_change

EPS = 1e-6
FLAT = 1e-9  # a deviation this small is rounding noise of equal values, hence zero


def seasonal_baseline(df: DataFrame, values: Sequence[str], by: Sequence[str], month: str = "month") -> DataFrame:
    """Month-of-year mean and population deviation per entity."""
    moy = F.month(month).alias("moy")
    return df.groupBy(*by, moy).agg(
        *[f(v).alias(f"{p}_{v}") for v in values for f, p in ((F.avg, "mu"), (F.stddev_pop, "sd"))]
    )


def ifpa_fixed(
    df: DataFrame, by: Sequence[str], price: str = "price", month: str = "month",
    gamma: float = 0.4, y0: int = 2000, y1: int = 2018, restrict_to_index=None,
) -> DataFrame:
    """Price-anomaly score against a month-of-year baseline of the years y0..y1.

    Baseline growth is taken inside the baseline years only, so its first 3 (12) months have
    none.  Missing mean counts as 0, missing or zero deviation as 1e-6.
    """
    src = df if restrict_to_index is None else df.where(restrict_to_index)
    base = src.where(F.year(month).between(y0, y1)).select(
        *by, month, log_growth(price, 3, by, month).alias("cq"), log_growth(price, 12, by, month).alias("ca")
    )
    stats = seasonal_baseline(base, ["cq", "ca"], by, month)
    g = src.withColumns({
        "cq": log_growth(price, 3, by, month), "ca": log_growth(price, 12, by, month), "moy": F.month(month),
    })
    g = g.join(stats, [*by, "moy"], "left")
    floor = lambda c: F.when(F.col(c) > FLAT, F.col(c)).otherwise(EPS)
    part = lambda v: (F.col(v) - F.coalesce(F.col(f"mu_{v}"), F.lit(0.0))) / floor(f"sd_{v}")
    z = gamma * part("cq") + (1 - gamma) * part("ca")
    return g.withColumn("z", z).drop("mu_cq", "sd_cq", "mu_ca", "sd_ca", "moy")


def ifpa_trailing(
    df: DataFrame, by: Sequence[str], price: str = "price", month: str = "month", gamma: float = 0.4, years: int = 10
) -> DataFrame:
    """The same score against a trailing window of ``years`` years, the current month included."""
    size = 12 * years
    g = df.withColumns({"cq": log_growth(price, 3, by, month), "ca": log_growth(price, 12, by, month)})
    w = over(by, month).rowsBetween(-(size - 1), 0)

    def part(v, least):
        enough = F.count(v).over(w) >= max(least, size // 6)
        sd = F.stddev_pop(v).over(w)
        return F.when(enough & (sd > FLAT), (F.col(v) - F.avg(v).over(w)) / sd)

    return g.withColumn("z", gamma * part("cq", 6) + (1 - gamma) * part("ca", 12))


def surge_rolling(df, by, price="price", month="month", k: int = 6, min_obs: int = 3) -> DataFrame:
    """Change against mean and population deviation of the k previous changes."""
    g = df.withColumn("mom", pct_change(price, by, month))
    w = over(by, month).rowsBetween(-k, -1)
    sd = F.stddev_pop("mom").over(w)
    ok = (F.count("mom").over(w) >= min_obs) & (sd > FLAT)
    return g.withColumn("z", F.when(ok, (F.col("mom") - F.avg("mom").over(w)) / sd))


def surge_quantile(df, by, price="price", month="month", q: float = 0.95) -> DataFrame:
    """Excess of the change over the q-quantile of the entity's own changes.

    The percentile buffer holds one entity's months, which the calendar bounds.
    """
    g = df.withColumn("mom", pct_change(price, by, month))
    cut = F.percentile("mom", F.lit(float(q))).over(Window.partitionBy(*by))
    return g.withColumn("z", F.col("mom") - cut)


def surge_percentile(df, by, price="price", month="month", p: float = 95) -> DataFrame:
    """E7."""
    return surge_quantile(df, by, price, month, p / 100.0)


def surge_pot(df, by, price="price", month="month", q: float = 0.05) -> DataFrame:
    """Peaks over threshold."""
    return surge_quantile(df, by, price, month, 1.0 - q)


DETECTORS = {
    "ifpa": ifpa_fixed, "ifpa_trailing": ifpa_trailing, "rolling_sigma": surge_rolling,
    "percentile": surge_percentile, "pot": surge_pot,
}


def flag_family(scored: DataFrame, thresholds: Sequence[float], strict: bool = False) -> DataFrame:
    """One copy of the panel per threshold, ``flag`` = z >= thr (or >), ``valid`` = score known."""
    t = scored.withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = F.col("z") > F.col("thr") if strict else F.col("z") >= F.col("thr")
    known = F.col("z").isNotNull() & ~F.isnan("z")
    return t.withColumn("valid", known.cast("int")).withColumn("flag", (known & hit).cast("int"))


def make_labels(
    flagged: DataFrame, by: Sequence[str], t: str, horizons: Sequence[int], timing: str = "window",
    refractory: int = 2, min_len: int = 1, event_window: int | None = None,
) -> DataFrame:
    """E10-E13 in order; long result (keys, t, horizon, y, m). ``by`` includes the threshold."""
    df = min_duration(flagged, "flag", by, t, min_len)
    src = "flag"
    if timing == "onset":
        df, src = onsets(df, "flag", by, t, refractory), "onset"
    keep = [c for c in df.columns if c not in ("flag", "valid")]
    hs = sorted(horizons)
    cols = {}
    for h in hs:
        if timing == "exact":
            y, m = label_exact(src, "valid", h, by, t)
        else:
            y, m = label_window(src, "valid", event_window or h, by, t)
        cols |= {f"_y{h}": y, f"_m{h}": m}
    pairs = [F.struct(F.lit(h).alias("horizon"), F.col(f"_y{h}").alias("y"), F.col(f"_m{h}").alias("m")) for h in hs]
    out = df.withColumns(cols).withColumn("_l", F.explode(F.array(*pairs)))
    return out.select(*keep, "flag", "valid", "_l.horizon", "_l.y", "_l.m")


def label_stats(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Valid cells, positives (y*m) and positive rate per group."""
    agg = labels.groupBy(*by).agg(
        F.sum("m").cast("bigint").alias("valid"), F.sum(F.col("y") * F.col("m")).cast("bigint").alias("positives")
    )
    return agg.withColumn("pos_rate", F.col("positives") / F.greatest("valid", F.lit(1)))
