"""Panel time-series operators (inventory E, C4, P5).

Inputs are panels: one row per entity and period, keys never null.  The window partitions are therefore
bounded by the calendar; raw rows must first be aggregated (see ``resample``), or go
through the segmented patterns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from .patterns import months_between_expr, only_row

UNB = Window.unboundedPreceding


def over(by: Sequence[str] | str, order: str) -> Window:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def complete_months(df: DataFrame, by: Sequence[str], month: str = "month", lo=None, hi=None) -> DataFrame:
    """C4: one row per key and month of the common span, nulls in the gaps, ordinal ``t``.

    The months are exploded per distinct key, so nothing is crossed with the data.
    """
    span = only_row(df, F.min(month).alias("lo"), F.max(month).alias("hi"))
    keys = df.select(*by).distinct().withColumn("_span", span)
    lo = F.lit(lo).cast("date") if lo else F.col("_span.lo")
    hi = F.lit(hi).cast("date") if hi else F.col("_span.hi")
    grid = keys.select(*by, F.posexplode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("t", month))
    return grid.join(df, [*by, month], "left")


def complete_days(df: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """C4 on a daily calendar."""
    span = only_row(df, F.min(day).alias("lo"), F.max(day).alias("hi"))
    keys = df.select(*by).distinct().withColumn("_span", span)
    grid = keys.select(
        *by, F.posexplode(F.sequence("_span.lo", "_span.hi", F.expr("interval 1 day"))).alias("t", day)
    )
    return grid.join(df, [*by, day], "left")


def ffill(value: str, by, order: str) -> Column:
    """Last known value, never backward."""
    return F.last(value, ignorenulls=True).over(over(by, order).rowsBetween(UNB, 0))


def log_growth(value: str, k: int, by, order: str) -> Column:
    """ln(x_t / x_{t-k}) on a completed calendar."""
    return F.ln(F.try_divide(F.col(value), F.lag(value, k).over(over(by, order))))


def pct_change(value: str, by, order: str, k: int = 1) -> Column:
    """E5."""
    return F.try_divide(F.col(value), F.lag(value, k).over(over(by, order))) - 1


def delta(value: str, k: int, by, order: str) -> Column:
    """Change over k periods."""
    return F.col(value) - F.lag(value, k).over(over(by, order))


def lags(value: str, ks: Sequence[int], by, order: str) -> dict[str, Column]:
    """Lag (positive k) and lead (negative k) columns."""
    w = over(by, order)
    return {
        f"{value}_lag{k}" if k >= 0 else f"{value}_lead{-k}": F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w)
        for k in ks
    }


def rolling(value: str, days: int, by, day: str, agg: str = "avg") -> Column:
    """Trailing statistic over the last ``days`` calendar days, gaps allowed."""
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(n).rangeBetween(-(days - 1), 0)
    return getattr(F, agg)(value).over(w)


def interpolate(value: str, by, order: str, max_gap: int) -> Column:
    """Linear interpolation inside gaps of at most ``max_gap`` missing rows; ``order`` is an ordinal."""
    w = over(by, order)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    back, fwd = w.rowsBetween(UNB, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v0, t0 = F.last(value, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    v1, t1 = F.first(value, ignorenulls=True).over(fwd), F.first(at, ignorenulls=True).over(fwd)
    line = v0 + (v1 - v0) * F.try_divide((F.col(order) - t0).cast("double"), (t1 - t0).cast("double"))
    return F.coalesce(F.col(value), F.when(t1 - t0 - 1 <= max_gap, line))


def percent_position(value: str, by, order_value: str | None = None) -> Column:
    """Percentile rank of a value within its own history."""
    return F.percent_rank().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order_value or value))


def with_runs(df: DataFrame, flag: str, by: Sequence[str], order: str) -> DataFrame:
    """Add ``run_id`` (ordinal of the run of equal flags) and ``run_len``."""
    w = over(by, order)
    changed = (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int")
    df = df.withColumn("_chg", changed).withColumn("run_id", F.sum("_chg").over(w.rowsBetween(UNB, 0))).drop("_chg")
    return df.withColumn("run_len", F.count(F.lit(1)).over(Window.partitionBy(*by, "run_id")))


def persistence(df: DataFrame, flag: str, by: Sequence[str], order: str, out: str = "persistence") -> DataFrame:
    """Number of consecutive flagged periods up to and including this one."""
    r = with_runs(df, flag, by, order)
    pos = F.row_number().over(Window.partitionBy(*by, "run_id").orderBy(order))
    return r.withColumn(out, F.when(F.col(flag) == 1, pos).otherwise(0)).drop("run_id", "run_len")


def min_duration(df: DataFrame, flag: str, by: Sequence[str], order: str, n: int) -> DataFrame:
    """Keep a flag only inside runs of at least ``n`` periods."""
    if n <= 1:
        return df
    r = with_runs(df, flag, by, order)
    return r.withColumn(flag, ((F.col(flag) == 1) & (F.col("run_len") >= n)).cast("int")).drop("run_id", "run_len")


def onsets(df: DataFrame, flag: str, by: Sequence[str], t: str, refractory: int, out: str = "onset") -> DataFrame:
    """Run starts; a start counts only more than ``refractory`` periods after the last accepted one.

    The greedy choice is a fold over the entity's sorted starts (at most one per period), made once per
    entity, on its first row, and handed to the others.
    """
    w = over(by, t)
    start = (F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0)
    df = df.withColumn("_start", start)
    if refractory <= 0:
        return df.withColumn(out, F.col("_start").cast("int")).drop("_start")
    whole = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_starts": F.collect_list(F.when(F.col("_start"), F.col(t))).over(whole), "_first": F.row_number().over(w) == 1})
    accept = F.aggregate(
        F.array_sort("_starts"),
        F.array().cast("array<int>"),
        lambda acc, s: F.when(
            (F.size(acc) == 0) | (s - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > refractory),
            F.array_append(acc, s.cast("int")),
        ).otherwise(acc),
    )
    return (
        df.withColumn("_once", F.when(F.col("_first"), accept))
        .withColumn("_ok", F.first("_once", ignorenulls=True).over(whole))
        .withColumn(out, F.array_contains("_ok", F.col(t).cast("int")).cast("int"))
        .drop("_start", "_starts", "_first", "_once", "_ok")
    )


def episodes(df: DataFrame, flag: str, by: Sequence[str], t: str, value: str) -> DataFrame:
    """One row per run of flagged periods with start, end, length and peak value."""
    r = with_runs(df, flag, by, t).where(F.col(flag) == 1)
    return r.groupBy(*by, "run_id").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count(F.lit(1)).alias("length"), F.max(value).alias("peak")
    ).drop("run_id")


def label_exact(flag: str, valid: str, h: int, by, order: str) -> tuple[Column, Column]:
    """Y and m taken at t+h; both 0 beyond the end."""
    w = over(by, order)
    return F.coalesce(F.lead(flag, h).over(w), F.lit(0)), F.coalesce(F.lead(valid, h).over(w), F.lit(0))


def label_window(flag: str, valid: str, ew: int, by, order: str) -> tuple[Column, Column]:
    """Any flag in (t, t+ew]; m=1 only if that window is complete and wholly valid, else y=m=0."""
    w = over(by, order).rowsBetween(1, ew)
    full = (F.count(F.lit(1)).over(w) == ew) & (F.min(valid).over(w) == 1)
    m = F.coalesce(full, F.lit(False))
    return F.when(m & (F.max(flag).over(w) > 0), 1).otherwise(0), m.cast("int")


def windows(df: DataFrame, cols: Sequence[str], by: Sequence[str], t: str, length: int, h_min: int) -> DataFrame:
    """For each end the ``length`` last steps up to ``t_end - h_min + 1``, ascending; whole windows only."""
    w = over(by, t).rowsBetween(-(length - 1), 0)
    packed = df.withColumn("steps", F.collect_list(F.struct(t, *cols)).over(w))
    packed = packed.where(F.size("steps") == length)
    # A window whose last step is s serves t_end = s + h_min - 1; step 0 is never used.
    out = packed.where(F.col(t) >= length).withColumn("t_end", (F.col(t) + (h_min - 1)).cast("int"))
    last = F.max(t).over(Window.partitionBy(*by))
    return out.withColumn("_last", last).where(F.col("t_end") <= F.col("_last")).select(*by, "t_end", "steps")


def since_event(flag: str, t: str, by) -> Column:
    """Periods since the last flagged period, null before the first."""
    return F.col(t) - F.last(F.when(F.col(flag) == 1, F.col(t)), ignorenulls=True).over(over(by, t).rowsBetween(UNB, 0))


def spread_vs_median(value: str, by, order: str, periods: int) -> Column:
    """Value minus the median of the trailing window ending one period earlier."""
    w = over(by, order).rowsBetween(-periods, -1)
    return F.col(value) - F.percentile(value, F.lit(0.5)).over(w)


def lag_kernel(value: str, weights: Mapping[int, float], by, order: str) -> Column:
    """Weighted sum of lagged values; null until the longest lag exists."""
    w = over(by, order)
    return sum((F.lag(value, k).over(w) * wt for k, wt in weights.items()), F.lit(0.0))


def event_study(panel: DataFrame, events: DataFrame, by: Sequence[str], t: str, value: str, k: int) -> DataFrame:
    """Mean path of ``value`` at offsets -k..k around events, and its gap to the mean at offsets < 0."""
    ev = events.select(*by, F.col(t).alias("_t0"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("offset"))
    ev = ev.withColumn(t, F.col("_t0") + F.col("offset"))
    hit = ev.join(panel.select(*by, t, value), [*by, t])
    path = hit.groupBy("offset").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    base = only_row(hit.where("offset < 0"), F.avg(value).alias("b"))
    return path.withColumn("_b", base).select("offset", "mean_value", "n", (F.col("mean_value") - F.col("_b.b")).alias("gap"))


def seasonal_naive(value: str, season: int, by, order: str) -> Column:
    """The value one season earlier."""
    return F.lag(value, season).over(over(by, order))


def month_ordinal(df: DataFrame, month: str = "month", out: str = "t") -> DataFrame:
    """Ordinal of a month within the table's own span."""
    lo = only_row(df, F.min(month).alias("lo"))
    return df.withColumn("_lo", lo).withColumn(out, months_between_expr(F.col(month), F.col("_lo.lo"))).drop("_lo")
