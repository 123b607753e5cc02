"""Forecast evaluation by any grouping (inventory H).

Input contract: grouping columns plus ``y_true`` (0/1), ``y_mask`` (0/1), ``y_prob``.  Every
metric looks at rows with ``y_mask = 1`` only.  Ranking metrics work on the table of distinct
scores and the segmented running sums, so neither one group nor one score range has to fit
into a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .draws import poisson
from .patterns import SEG, cut_points, join_same, quantile_hits, running_sums, with_segment


def bin_edges(bins: int = 10) -> list[float]:
    """Edges of equal-width bins: multiples of the step in binary floating point (0.30000000000000004 for 3 of 10)."""
    step = 1.0 / bins
    return [0.0] + [i * step for i in range(1, bins)] + [1.0]


def observed(preds: DataFrame) -> DataFrame:
    p = F.col("y_prob")
    return preds.where((F.col("y_mask") == 1) & p.isNotNull() & ~F.isnan(p))


def bin_of(p: Column | str, bins: int = 10, include_right: bool = False) -> Column:
    """Equal-width bin by comparison with the edges; p = 1.0 lands in bin ``bins`` unless included."""
    c = F.col(p) if isinstance(p, str) else p
    edges = bin_edges(bins)[1:] if not include_right else bin_edges(bins)[1:-1]
    return sum(((c >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def brier(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """H1."""
    return observed(preds).groupBy(*by).agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))).alias("brier"))


def _ece_sum(bin_: Column, gap: Column, bins: int, n: Column) -> Column:
    parts = (F.abs(F.coalesce(F.sum(F.when(bin_ == b, gap)), F.lit(0.0))) for b in range(bins))
    return sum(parts, F.lit(0.0)) / n


def ece(preds: DataFrame, by: Sequence[str], bins: int = 10, include_right: bool = False) -> DataFrame:
    """H2 in one aggregation: sum over bins of |sum(y) - sum(p)| / n.

    A score of exactly 1.0 counts in n but in no bin unless ``include_right``.
    """
    v = observed(preds).withColumn("_b", bin_of("y_prob", bins, include_right))
    gap = (F.col("y_true") - F.col("y_prob")).cast("double")
    return v.groupBy(*by).agg(_ece_sum(F.col("_b"), gap, bins, F.count(F.lit(1))).alias("ece"))


def reliability(preds: DataFrame, by: Sequence[str], bins: int = 10, include_right: bool = False) -> DataFrame:
    """H3: bin, n, mean score, event rate."""
    v = observed(preds).withColumn("bin", bin_of("y_prob", bins, include_right)).where(F.col("bin") < bins)
    return v.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_prob").alias("mean_p"), F.avg("y_true").alias("event_rate")
    )


def score_table(preds: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct scores with the number of rows and positives (map-side combined)."""
    w = F.col(weight) if weight else F.lit(1)
    return observed(preds).groupBy(*by, F.col("y_prob").alias("p")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("y_true")).alias("pos")
    )


def ranked(preds: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Score table with inclusive running counts ``cum_n, cum_pos`` and totals ``tot_n, tot_pos``.

    ``at_n, at_pos`` count the rows with a score at or above this one.
    """
    cuts = cut_points(observed(preds), "y_prob")
    r = running_sums(score_table(preds, by, weight), by, "p", {"n": "n", "pos": "pos"}, cuts=cuts)
    return r.withColumns({
        "at_n": F.col("tot_n") - F.col("cum_n") + F.col("n"),
        "at_pos": F.col("tot_pos") - F.col("cum_pos") + F.col("pos"),
    })


def _auroc_expr() -> Column:
    neg = F.col("n") - F.col("pos")
    below = F.col("cum_n") - F.col("cum_pos") - neg
    wins = F.sum(F.col("pos") * (below + neg * 0.5))
    p, q = F.max("tot_pos").cast("double"), (F.max("tot_n") - F.max("tot_pos")).cast("double")
    return F.when((p > 0) & (q > 0), wins / (p * q))


def _auprc_expr() -> Column:
    return F.when(
        F.max("tot_pos") > 0, F.sum(F.col("pos") * (F.col("at_pos") / F.col("at_n"))) / F.max("tot_pos")
    )


def auroc(preds: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """H4: probability that a positive outranks a negative, ties one half; null for one class."""
    return ranked(preds, by, weight).groupBy(*by).agg(_auroc_expr().alias("auroc"))


def auprc(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """H5: sum of recall steps times precision; null without positives."""
    return ranked(preds, by).groupBy(*by).agg(_auprc_expr().alias("auprc"))


def metric_table(preds: DataFrame, by: Sequence[str], bins: int = 10, weight: str | None = None) -> DataFrame:
    """N, pos, auroc, auprc, brier, ece per group, from one ranked score table."""
    r = ranked(preds, by, weight).withColumn("_b", bin_of("p", bins))
    n = F.col("n")
    sq = F.col("pos") * F.pow(1 - F.col("p"), F.lit(2.0)) + (n - F.col("pos")) * F.pow(F.col("p"), F.lit(2.0))
    return r.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), _auroc_expr().alias("auroc"), _auprc_expr().alias("auprc"),
        (F.sum(sq) / F.sum("n")).alias("brier"),
        _ece_sum(F.col("_b"), F.col("pos") - n * F.col("p"), bins, F.sum("n")).alias("ece"),
    )


def roc_curve(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """H6: one point per distinct threshold (score at or above it is an alarm)."""
    return ranked(preds, by).select(
        *by, F.col("p").alias("thr"),
        F.try_divide(F.col("at_n") - F.col("at_pos"), F.col("tot_n") - F.col("tot_pos")).alias("fpr"),
        F.try_divide("at_pos", "tot_pos").alias("tpr"),
    )


def pr_curve(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """H7: one point per distinct threshold plus the end point (recall 0, precision 1)."""
    pts = ranked(preds, by).where("tot_pos > 0").select(
        *by, F.col("p").alias("thr"), (F.col("at_pos") / F.col("tot_pos")).alias("recall"),
        (F.col("at_pos") / F.col("at_n")).alias("precision"),
    )
    ends = observed(preds).groupBy(*by).agg(F.sum("y_true").alias("_p")).where("_p > 0").select(
        *by, F.lit(None).cast("double").alias("thr"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return pts.unionByName(ends)


def confusion(preds: DataFrame, by: Sequence[str], thr: Column | float) -> DataFrame:
    """Tp, fp, fn, tn; an alarm is a score at or above the threshold."""
    v = observed(preds)
    alarm = F.col("y_prob") >= (thr if isinstance(thr, Column) else F.lit(float(thr)))
    c = lambda cond: F.sum(cond.cast("bigint"))
    y = F.col("y_true") == 1
    return v.groupBy(*by).agg(
        c(alarm & y).alias("tp"), c(alarm & ~y).alias("fp"), c(~alarm & y).alias("fn"), c(~alarm & ~y).alias("tn")
    )


def quantile_sweep(preds: DataFrame, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Score quantiles as thresholds with the counts at and above them, from the ranked table alone.

    Result (by, q, thr, at_n, at_pos, tot_n, tot_pos).  An interpolated threshold lies between two
    neighbouring scores, so its counts are those of the upper one; no row is joined to a threshold.
    """
    r = ranked(preds, by)
    last = (F.col("tot_n") - 1).cast("double")
    lo, hi = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    inside = lambda k: (k >= lo) & (k <= hi)
    hits = quantile_hits(qs, lo, hi, last)
    pos = F.col("q") * last
    row = F.struct("p", "at_n", "at_pos")
    g = r.withColumn("q", F.explode(hits)).groupBy(*by, "q").agg(
        F.max(F.when(inside(F.floor(pos)), row)).alias("_a"), F.max(F.when(inside(F.ceil(pos)), row)).alias("_b"),
        F.max("tot_n").alias("tot_n"), F.max("tot_pos").alias("tot_pos"),
    )
    thr = F.col("_a.p") + (F.col("_b.p") - F.col("_a.p")) * (pos - F.floor(pos))
    g = g.withColumn("thr", thr).withColumn("_r", F.when(F.col("thr") <= F.col("_a.p"), F.col("_a")).otherwise(F.col("_b")))
    return g.select(*by, "q", "thr", F.col("_r.at_n").alias("at_n"), F.col("_r.at_pos").alias("at_pos"), "tot_n", "tot_pos")


def budget_sweep(preds: DataFrame, by: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """:func:`quantile_sweep` at the (1 - b) quantiles, keyed by ``budget``."""
    qs: dict[float, list[float]] = {}
    for x in dict.fromkeys(map(float, budgets)):  # budgets outside 0..1 share the outermost quantile
        qs.setdefault(min(max(1.0 - x, 0.0), 1.0), []).append(x)
    back = F.create_map(*[y for q, some in qs.items() for y in (F.lit(q), F.array(*map(F.lit, some)))])
    return quantile_sweep(preds, by, list(qs)).withColumn("budget", F.explode(back[F.col("q")])).drop("q")


def budget_thresholds(preds: DataFrame, by: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """I4 for several budgets: the (1 - b) quantile of the group's scores."""
    return budget_sweep(preds, by, budgets).select(*by, "budget", "thr")


def budget_curve(preds: DataFrame, by: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """Per budget the threshold, hit rate and false alarms per 100 rows."""
    return budget_sweep(preds, by, budgets).select(
        *by, "budget", "thr", (F.col("at_pos") / F.greatest("tot_pos", F.lit(1))).alias("hit"),
        ((F.col("at_n") - F.col("at_pos")) / (F.col("tot_n") / 100.0)).alias("fa_per_100"),
    )


def budget_metrics(preds: DataFrame, by: Sequence[str], budget: float) -> DataFrame:
    """H13."""
    return budget_curve(preds, by, [budget]).drop("budget")


def gen_gap(metrics: DataFrame, by: Sequence[str], names: Sequence[str], a="test", b="val") -> DataFrame:
    """Metric on split ``a`` minus metric on split ``b``."""
    pick = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
    return metrics.groupBy(*by).agg(*[(pick(c, a) - pick(c, b)).alias(f"gap_{c}") for c in names])


def uplift(metrics: DataFrame) -> DataFrame:
    """AUPRC over prevalence."""
    return metrics.withColumn("uplift", F.try_divide(F.col("auprc"), F.col("pos") / F.col("n")))


def brier_decomp(preds: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty over the reliability bins."""
    rel = reliability(preds, by, bins, include_right=True)
    w = Window.partitionBy(*by)
    base = F.sum(F.col("n") * F.col("event_rate")).over(w) / F.sum("n").over(w)
    r = rel.withColumn("_base", base)
    share = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    return r.groupBy(*by).agg(
        share(F.pow(F.col("mean_p") - F.col("event_rate"), F.lit(2.0))).alias("reliability"),
        share(F.pow(F.col("event_rate") - F.col("_base"), F.lit(2.0))).alias("resolution"),
        F.max(F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"),
    )


def horizon_delta(metrics: DataFrame, by: Sequence[str], name: str, pairs=((5, 3), (3, 1))) -> DataFrame:
    """Differences of one metric between horizons."""
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col(name)))
    return metrics.groupBy(*by).agg(*[(at(a) - at(b)).alias(f"d{a}_{b}") for a, b in pairs])


def ablation_table(metrics: DataFrame, by: Sequence[str], config: str, name: str) -> DataFrame:
    """Best configuration per group (ties: the first name) and the spread to the worst."""
    m = metrics.where(F.col(name).isNotNull())
    return m.groupBy(*by).agg(
        F.min_by(config, F.struct(-F.col(name), F.col(config))).alias("best"), F.max(name).alias("best_value"),
        (F.max(name) - F.min(name)).alias("spread"), F.count(F.lit(1)).alias("configs"),
    )


def dispersion(metrics: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Median and interquartile range of per-period metrics, and periods without positives.

    One row per period enters, so the percentile buffer is bounded by the calendar.
    """
    q = F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), F.sum((F.col("pos") == 0).cast("int")).alias("zero_pos"), q.alias("_q")
    ).select(*by, "periods", "zero_pos", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def uniform_hash(*cols: Column) -> Column:
    """Deterministic uniform in [0, 1) from the row's key: the same after any task retry."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


REPLICATES = "segment double, pos array<double>, neg array<double>, wins array<double>, loss array<double>"


def _replicate_sums(cells: DataFrame, by: Sequence[str], replicates: int, clustered: bool) -> DataFrame:
    """Per group and segment of scores, for every replicate: weights of positives and negatives, pairs
    in the right order within the segment (ties one half), and squared error.

    ``cells`` has the group, ``_seg``, y_prob, n, pos and the key hashes _kp and _kn; clustered cells
    weigh all their rows alike.
    """
    keep = [f"{c} {cells.schema[c].dataType.simpleString()}" for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        p, n, pos, kp, kn = (t.column(c).to_numpy() for c in ("y_prob", "n", "pos", "_kp", "_kn"))
        order = np.lexsort((kn, kp, p))
        p, n, pos, kp, kn = p[order], n[order], pos[order], kp[order], kn[order]
        above, below, wins, loss = (np.zeros(replicates) for _ in range(4))
        edges = np.nonzero(np.concatenate([[True], p[1:] != p[:-1]]))[0]
        at = 0
        while at < len(edges):
            # Whole scores, about a thousand cells at a time.
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 1000)))
            lo, hi = edges[at], edges[to] if to < len(edges) else len(p)
            if clustered:
                w = poisson(kp[lo:hi], np.ones(hi - lo), replicates)
                wp, wn = w * pos[lo:hi, None], w * (n - pos)[lo:hi, None]
            else:
                wp, wn = poisson(kp[lo:hi], pos[lo:hi], replicates), poisson(kn[lo:hi], (n - pos)[lo:hi], replicates)
            loss += (wp * (1 - p[lo:hi, None]) ** 2 + wn * p[lo:hi, None] ** 2).sum(axis=0)
            wp, wn = (np.add.reduceat(x, edges[at:to] - lo, axis=0) for x in (wp, wn))
            before = below + np.cumsum(wn, axis=0) - wn
            wins += (wp * (before + wn / 2)).sum(axis=0)
            above, below, at = above + wp.sum(axis=0), below + wn.sum(axis=0), to
        one = t.slice(0, 1)
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (above, below, wins, loss)]
        yield pa.RecordBatch.from_arrays([*(one.column(c).chunk(0) for c in (*by, "_seg")), *lists], names=[*by, "segment", "pos", "neg", "wins", "loss"])

    schema = ", ".join([*keep, REPLICATES])
    return cells.groupBy(*by, "_seg").applyInArrow(run, schema)


def bootstrap_ci(
    preds: DataFrame, by: Sequence[str], key: Sequence[str] = (), replicates: int = 1000, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """H21 (and L8 with the cluster as ``key``): percentile intervals of AUROC and Brier.

    Rows are first summed to cells of equal score (and cluster); a cell's weight in a replicate is a
    Poisson number with the mean of its rows, or one Poisson(1) number per cluster.  The cells are cut
    by score once, and a segment sends one vector per group with all replicates, so the shuffle is
    cells plus segments x replicates.
    """
    v = observed(preds)
    tied = ["y_prob", *key]
    cells = v.groupBy(*by, *tied).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos"))
    hashed = [F.col(c) for c in (key or (*by, "y_prob"))]
    cells = with_segment(cells, "y_prob", cut_points(cells, "y_prob"))
    cells = cells.select(*by, F.col(SEG).alias("_seg"), F.col("y_prob").cast("double").alias("y_prob"), "n", "pos", F.xxhash64(*hashed, F.lit(seed)).alias("_kp"), F.xxhash64(*hashed, F.lit(seed), F.lit("n")).alias("_kn"))
    sums = _replicate_sums(cells, by, int(replicates), bool(key))
    rows = sums.select(*by, "segment", F.posexplode(F.arrays_zip("pos", "neg", "wins", "loss")).alias("replicate", "x")).select(*by, "segment", "replicate", "x.*")
    w = Window.partitionBy(*by, "replicate").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    m = rows.groupBy(*by, "replicate").agg(
        F.try_divide(F.sum(F.col("wins") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg")).alias("auroc"),
        F.try_divide(F.sum("loss"), F.sum("pos") + F.sum("neg")).alias("brier"),
    )
    a = (1 - level) / 2
    ends = F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))
    out = m.where("brier IS NOT NULL").groupBy(*by).agg(
        F.percentile("auroc", ends).alias("_a"), F.percentile("brier", ends).alias("_b"), F.count(F.lit(1)).alias("replicates")
    )
    cols = [F.col(f"_{k}")[i].alias(f"{n}_{e}") for k, n in (("a", "auroc"), ("b", "brier")) for i, e in enumerate(("lo", "mid", "hi"))]
    return out.select(*by, "replicates", *cols)


def best_epoch(hist: DataFrame, by: Sequence[str], epoch: str, score: str, patience: int) -> DataFrame:
    """Last improvement (ties count) before ``patience`` epochs pass without one."""
    w = Window.partitionBy(*by).orderBy(epoch)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = hist.withColumn("_up", before.isNull() | (F.col(score) >= before))
    last = F.last(F.when(F.col("_up"), F.col(epoch)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("_last", last)
    h = h.withColumn("_stop", F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch))).over(Window.partitionBy(*by)))
    alive = h.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return alive.groupBy(*by).agg(
        F.max("_last").alias("best_epoch"), F.max(epoch).alias("stopped_at"),
        F.max_by(score, F.when(F.col("_up"), F.col(epoch))).alias("best_score"),
    )


def verify_tables(yearly: DataFrame, total: DataFrame, by: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Published totals against sums of their parts; rate must equal positives / valid."""
    parts = yearly.groupBy(*by).agg(F.sum("valid").alias("_v"), F.sum("positives").alias("_p"))
    j = join_same(total, parts, by, "left")
    rate = F.col("_p") / F.greatest("_v", F.lit(1))
    return j.select(
        *by, "valid", "positives", (F.col("valid") == F.col("_v")).cast("int").alias("valid_ok"),
        (F.col("positives") == F.col("_p")).cast("int").alias("positives_ok"),
        (F.abs(F.col("pos_rate") - rate) <= tol).cast("int").alias("rate_ok"),
    )


def scaled_errors(df: DataFrame, by: Sequence[str], y: str, forecast: str, naive: str) -> DataFrame:
    """MASE and RMSSE of a forecast, scaled by the seasonal-naive error."""
    e, s = F.col(y) - F.col(forecast), F.col(y) - F.col(naive)
    return df.groupBy(*by).agg(
        F.try_divide(F.avg(F.abs(e)), F.avg(F.abs(s))).alias("mase"), F.sqrt(F.try_divide(F.avg(e * e), F.avg(s * s))).alias("rmsse")
    )


def coverage(df: DataFrame, by: Sequence[str], y: str, lo: str, hi: str) -> DataFrame:
    """Share of outcomes inside the band and mean band width."""
    d = df.where(F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull())
    return d.groupBy(*by).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("int")).alias("coverage"),
        F.avg(F.col(hi) - F.col(lo)).alias("width"), F.count(F.lit(1)).alias("n"),
    )


def support_curve(metrics: DataFrame, by: Sequence[str], name: str = "auroc") -> DataFrame:
    """How a metric moves with the number of positives: correlation and trend line."""
    m = metrics.where(F.col(name).isNotNull())
    x = F.col("pos").cast("double")
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.corr(x, F.col(name)).alias("corr"),
        F.regr_slope(F.col(name), x).alias("slope"), F.regr_intercept(F.col(name), x).alias("intercept"),
    )
