"""Physical patterns that the operators share.

*Segments.*  A window needs all rows of its partition in one task.  That is safe
for panels (one row per entity and month, so a partition is bounded by the
calendar) and unsafe for raw rows, where one key may hold a third of the table.
Raw rows are therefore cut along the *ordering* column into segments of about
equal size; windows run per (key, segment) and a small per-segment summary
carries totals or last values from one segment to the next.  The cut points are
a bounded list of doubles (one per shuffle partition) fetched to the driver and
used as literals, so a recomputed task always lands on the same segments.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import NumericType

from ..session import materialise

SEG = "_seg"


def segment_count(df: DataFrame) -> int:
    """Segments follow the cluster's own sizing: one per shuffle partition."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, on: str, n: int | None = None) -> list[float]:
    """At most ``n - 1`` increasing cut points of a numeric column (one sketch pass).

    Results never depend on how good the cuts are, only the balance does.
    """
    n = n or segment_count(df)
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.approxQuantile(on, probs, 1.0 / (4 * n))))


def cuts_and_ties(df: DataFrame, on: str, order: Sequence[Column | str], n: int | None = None) -> tuple[list[float], dict[float, list[float]]]:
    """Cut points of ``on``, and for values that fill several segments alone the cut points of their ties.

    Ties are cut along the next numeric column of ``order``; without one they stay together.  A value
    that holds k of the cut points gets about k cuts of its own.
    """
    n = n or segment_count(df)
    found = df.approxQuantile(on, [i / n for i in range(1, n)], 1.0 / (4 * n))
    cuts = sorted(set(found))
    hot = {v: found.count(v) for v in cuts if found.count(v) > 1}
    tie = next((c for c in order if isinstance(c, str) and c != on and isinstance(df.schema[c].dataType, NumericType)), None)
    if not hot or tie is None:
        return cuts, {}
    most = max(hot.values())
    probs = F.array(*[F.lit(i / (most + 1)) for i in range(1, most + 1)])
    rows = df.where(F.col(on).isin(list(hot))).groupBy(F.col(on).cast("double").alias("v")).agg(F.percentile_approx(F.col(tie).cast("double"), probs, F.lit(10 * n)).alias("q")).collect()
    return cuts, {r["v"]: [tie, *sorted(set(r["q"]))] for r in rows if r["q"]}


def with_segment(df: DataFrame, on: str, cuts: Sequence[float], out: str = SEG, ties: Mapping[float, Sequence] | None = None) -> DataFrame:
    """Add the segment of ``on`` (binary search over the literal cuts); nulls come first, NaN last.

    ``ties`` (:func:`cuts_and_ties`) cuts single values further, in steps of a fraction.
    """
    if not cuts:
        return df.withColumn(out, F.when(F.col(on).isNull(), -1.0).otherwise(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    seg = Bucketizer(splits=splits, inputCol=on, outputCol=out, handleInvalid="keep").transform(df)
    seg = seg.withColumn(out, F.coalesce(out, F.lit(-1.0)))
    if not ties:
        return seg
    part = F.lit(0.0)
    for v, (tie, *at) in ties.items():
        # A cut value opens its bucket, so its rows come first there and the bucket's others after them.
        below = F.aggregate(F.array(*map(F.lit, at)), F.lit(0.0), lambda a, q: a + (F.col(tie).cast("double") >= q).cast("double"))
        mine = F.coalesce(below, F.lit(0.0)) / F.lit(2.0 * (len(at) + 1))
        part = F.when(F.col(on) == F.lit(v), mine).when(F.col(out) == F.lit(float(bisect_right(cuts, v))), F.lit(0.75)).otherwise(part)
    return seg.withColumn(out, F.col(out) + part)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys."""
    tmp = {k: f"_r_{k}" for k in keys}
    r = right.withColumnsRenamed(tmp)
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[tmp[k]])
    return left.join(r, cond, how).drop(*tmp.values())


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = 100_000) -> DataFrame:
    """Join raw rows to a derived table that is usually short (thresholds, per-variable statistics).

    The derived table is written once and its rows are counted: up to ``limit`` it is broadcast,
    so a few hot keys never gather the raw rows in a few tasks; beyond that the plain (skew-aware)
    join applies.
    """
    table = materialise(small, "small")
    hint = F.broadcast(table) if table.count() <= limit else table
    return join_same(big, hint, keys, how)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    segment_on: str,
    sums: Mapping[str, str],
    order: Sequence[Column | str] | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sums within ``by`` along an order, whatever the group size.

    ``sums`` maps an input column to a suffix ``s``; the result gains ``cum_s`` and the
    group total ``tot_s``.  ``order`` (default: ``segment_on``) must be a total order that
    is monotone in the numeric column ``segment_on``.
    """
    by = list(by)
    order = list(order or [segment_on])
    cuts, ties = cuts_and_ties(df, segment_on, order) if cuts is None else (cuts, None)
    seg = with_segment(df, segment_on, cuts, ties=ties)
    seg, key = _keyed(seg, by)
    per_segment = seg.groupBy(*key, SEG).agg(*[F.sum(c).alias(f"_s_{s}") for c, s in sums.items()])
    before = Window.partitionBy(*key).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    offsets = per_segment.select(
        *key,
        SEG,
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums.values()],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums.values()],
    )
    inside = Window.partitionBy(*key, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.select("*", *[F.sum(c).over(inside).alias(f"_l_{s}") for c, s in sums.items()])
    out = local.join(offsets, [*key, SEG])
    out = out.withColumns({f"cum_{s}": F.col(f"_l_{s}") + F.col(f"_o_{s}") for s in sums.values()})
    names = [*df.columns, *[f"tot_{s}" for s in sums.values()], *[f"cum_{s}" for s in sums.values()]]
    return out.select(*names)


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One never-null struct key, so that windows and the join on it share one partitioning.

    Struct equality treats null fields as equal, hence null groups are kept.
    """
    if not by:
        return df, []
    return df.withColumn("_key", F.struct(*by)), ["_key"]


def global_index(df: DataFrame, segment_on: str, order: Sequence[Column | str], out: str = "idx") -> DataFrame:
    """0-based position in a global total order, without a single-task sort."""
    res = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [], segment_on, {"_one": "one"}, order)
    return res.withColumn(out, F.col("cum_one") - 1).drop("_one", "cum_one", "tot_one")


def previous_value(
    df: DataFrame,
    by: Sequence[str],
    segment_on: str,
    order: Sequence[Column | str],
    value: str,
    out: str,
    inclusive: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Latest non-null ``value`` before (or up to) each row of its key, for hot keys too.

    ``order`` must be a total order, monotone in the numeric column ``segment_on``.
    """
    by = list(by)
    cuts, ties = cuts_and_ties(df, segment_on, order) if cuts is None else (cuts, None)
    seg = with_segment(df, segment_on, cuts, ties=ties)
    seg, key = _keyed(seg, by)
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*key, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    per_segment = seg.groupBy(*key, SEG).agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("_last"))
    before = Window.partitionBy(*key).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_segment.select(*key, SEG, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    local = seg.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    res = local.join(carried, [*key, SEG])
    return res.select(*df.columns, F.coalesce("_local", "_carry").alias(out))


def quantile_hits(qs: Sequence[float], lo: Column, hi: Column, last: Column) -> Column:
    """The levels whose lower or upper order statistic falls on the positions lo..hi of 0..last.

    For an evenly spaced list only the levels near lo/last and hi/last are looked at.
    """
    lits = F.array(*[F.lit(float(q)) for q in qs])
    m = len(qs) - 1
    if m > 16 and all(q == i / m for i, q in enumerate(qs)):
        at = lambda k: F.try_divide(k.cast("double") * m, last)
        a = F.coalesce(F.greatest(F.floor(at(lo - 1)), F.lit(0)), F.lit(0))
        b = F.coalesce(F.least(F.ceil(at(hi + 1)), F.lit(m)), F.lit(m))
        lits = F.slice(lits, (a + 1).cast("int"), (b - a + 1).cast("int"))
    inside = lambda k: (k >= lo) & (k <= hi)
    return F.filter(lits, lambda q: inside(F.floor(q * last)) | inside(F.ceil(q * last)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], exact: bool = True) -> DataFrame:
    """Long table (by, q, value, n) of linearly interpolated quantiles.

    Exact mode ranks the distinct values with :func:`running_sums`, so no task holds a whole
    group; ``exact=False`` uses the built-in sketch.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    lits = [float(q) for q in qs]
    if not exact:
        agg = rows.groupBy(*by).agg(
            F.percentile_approx("_v", lits, 10000).alias("_a"), F.count(F.lit(1)).alias("n")
        )
        return agg.select(*by, "n", F.posexplode("_a").alias("_i", "value")).select(
            *by, F.element_at(F.array(*map(F.lit, lits)), F.col("_i") + 1).alias("q"), "value", "n"
        )
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, by, "_v", {"_n": "n"}, cuts=cut_points(rows, "_v"))
    ranked = ranked.select(
        *by, "_v", (F.col("cum_n") - F.col("_n")).alias("_lo"), (F.col("cum_n") - 1).alias("_hi"),
        F.col("tot_n").alias("n"),
    )
    last = (F.col("n") - 1).cast("double")
    inside = lambda k: (k >= F.col("_lo")) & (k <= F.col("_hi"))
    picked = ranked.withColumn("q", F.explode(quantile_hits(lits, F.col("_lo"), F.col("_hi"), last)))
    pos = F.col("q") * last
    return (
        picked.groupBy(*by, "q")
        .agg(
            F.max(F.when(inside(F.floor(pos)), F.col("_v"))).alias("_a"),
            F.max(F.when(inside(F.ceil(pos)), F.col("_v"))).alias("_b"),
            F.max("n").alias("n"),
        )
        .select(
            *by, "q",
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("q") * last - F.floor(F.col("q") * last))).alias("value"),
            "n",
        )
    )


def quantiles_wide(df, by, value, named: Mapping[str, float], exact: bool = True) -> DataFrame:
    """One row per group with one column per named quantile."""
    long = quantiles(df, by, value, list(named.values()), exact)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(k) for k, q in named.items()]
    return long.groupBy(*by).agg(*aggs)


def only_row(df: DataFrame, *cols: Column) -> Column:
    """A one-row aggregate as a scalar struct column (an uncorrelated scalar subquery)."""
    return df.agg(F.struct(*cols).alias("_one")).scalar()


def months_between_expr(later: Column | str, earlier: Column | str) -> Column:
    """Whole calendar months between two month-start dates, as INT."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (later, earlier))
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


def micros(ts: Column | str) -> Column:
    """Timestamp (with or without zone) to BIGINT microseconds, in UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
