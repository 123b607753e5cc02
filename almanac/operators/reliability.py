"""Reliability, paired tests, influence and curation (inventory L)."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from .metrics import bootstrap_ci, observed, ranked
from .patterns import cut_points, join_same, join_small, only_row, quantiles, running_sums


def _as_scores(df: DataFrame, conf: str, err: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.col(err).alias("y_true"), F.lit(1).alias("y_mask"), F.col(conf).alias("y_prob"))


def risk_coverage(df: DataFrame, conf: str, err: str, by: Sequence[str] = ()) -> DataFrame:
    """L1: one point per distinct confidence: coverage and risk of the rows at or above it."""
    r = ranked(_as_scores(df, conf, err, by), by)
    return r.select(
        *by, F.col("p").alias("conf"), "n", (F.col("at_n") / F.col("tot_n")).alias("coverage"), (F.col("at_pos") / F.col("at_n")).alias("risk"),
        (F.col("at_pos") / F.col("tot_n")).alias("generalised_risk"))


def aurc(df: DataFrame, conf: str, err: str, by: Sequence[str] = ()) -> DataFrame:
    """L1/L2: mean risk over the ranking (AURC) and mean generalised risk (AUGRC); tied rows share a point."""
    c = risk_coverage(df, conf, err, by)
    mean = lambda x: F.sum(F.col("n") * F.col(x)) / F.sum("n")
    return c.groupBy(*by).agg(mean("risk").alias("aurc"), mean("generalised_risk").alias("augrc"))


def risk_at(df: DataFrame, conf: str, err: str, coverage: float, by: Sequence[str] = ()) -> DataFrame:
    """L3: risk at the smallest attainable coverage of at least ``coverage``."""
    c = risk_coverage(df, conf, err, by).where(F.col("coverage") >= coverage)
    return c.groupBy(*by).agg(F.min("coverage").alias("coverage"), F.min_by("risk", "coverage").alias("risk"))


def ece_mass(preds: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """L4: calibration error over equal-mass bins with the sampling variance taken off.

    A row's bin follows from the rank of its score; equal scores share a bin.
    """
    r = ranked(preds, by)
    b = F.least(F.floor((F.col("cum_n") - F.col("n")) * bins / F.col("tot_n")), F.lit(bins - 1))
    g = r.groupBy(*by, b.alias("bin")).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mp"), (F.sum("pos") / F.sum("n")).alias("er"))
    gap = F.pow(F.col("mp") - F.col("er"), F.lit(2.0)) - F.coalesce(F.try_divide(F.col("er") * (1 - F.col("er")), F.col("n") - 1), F.lit(0.0))
    plain = F.sum(F.col("n") * F.abs(F.col("mp") - F.col("er"))) / F.sum("n")
    return g.groupBy(*by).agg(plain.alias("ece_mass"), F.sqrt(F.greatest(F.sum(F.col("n") * gap) / F.sum("n"), F.lit(0.0))).alias("debiased"))


def nll(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean negative log likelihood on the clamped score."""
    from ..functions.scalars import bce

    return observed(preds).groupBy(*by).agg(F.avg(bce("y_true", "y_prob")).alias("nll"))


def macro_f1(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and unweighted mean F1 over the classes seen in truth or prediction."""
    c = df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    side = F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    long = c.withColumn("_h", hit).withColumn("_s", F.explode(side))
    per = long.groupBy(*by, "_s.cls").agg(
        F.sum(F.col("n") * F.col("_s.t")).alias("t"), F.sum(F.col("n") * F.col("_s.p")).alias("p"), F.sum(F.col("_h") * F.col("_s.t")).alias("tp"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def mcnemar(pairs: DataFrame, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Discordant counts of two models on the same samples and the continuity-corrected statistic."""
    right = lambda p: (F.col(p) >= cut).cast("int") == F.col("y_true")
    c = lambda cond: F.sum(cond.cast("bigint"))
    g = pairs.groupBy(*by).agg(c(right("p_a") & ~right("p_b")).alias("b"), c(~right("p_a") & right("p_b")).alias("c"))
    return g.withColumn("statistic", F.try_divide(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), F.lit(2.0)), F.col("b") + F.col("c")))


def mcnemar_p(statistic: float) -> float:
    """Upper tail of the chi-square law with one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2.0))


def cluster_bootstrap(preds: DataFrame, by: Sequence[str], cluster: Sequence[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """The bootstrap with one Poisson weight per cluster and replicate."""
    return bootstrap_ci(preds, by, cluster, replicates, seed)


def holm(tests: DataFrame, family: Sequence[str], test: str, p: str = "p") -> DataFrame:
    """Holm (step-down) and Hochberg (step-up) adjusted p-values within a family of tests."""
    w = Window.partitionBy(*family).orderBy(p, test)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    down = w.rowsBetween(Window.unboundedPreceding, 0)
    up = w.rowsBetween(0, Window.unboundedFollowing)
    t = tests.withColumn("_r", raw)
    return t.withColumns({"holm": F.least(F.max("_r").over(down), F.lit(1.0)), "hochberg": F.least(F.min("_r").over(up), F.lit(1.0))}).drop("_r")


def friedman(scores: DataFrame, dataset: Sequence[str], method: str, score: str) -> DataFrame:
    """Mean rank of every method over the datasets (best = 1, ties averaged) and the Friedman statistic."""
    w = Window.partitionBy(*dataset)
    r = F.rank().over(w.orderBy(F.desc(score))) + (F.count(F.lit(1)).over(Window.partitionBy(*dataset, score)) - 1) / 2
    ranks = scores.where(F.col(score).isNotNull()).withColumn("_r", r).withColumn("_k", F.count(F.lit(1)).over(w))
    m = ranks.groupBy(method).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("datasets"), F.max("_k").alias("_k"))
    stat = only_row(m, F.sum(F.pow("mean_rank", F.lit(2.0))).alias("s"), F.max("datasets").alias("n"), F.max("_k").alias("k"))
    n, k = F.col("_s.n"), F.col("_s.k")
    return m.withColumn("_s", stat).select(
        method, "mean_rank", "datasets", (12 * n / (k * (k + 1)) * (F.col("_s.s") - k * (k + 1) * (k + 1) / 4.0)).alias("friedman"))


def rank_table(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value (``_v``; 1-based, ties averaged)."""
    x = df.select(*by, F.col(value).cast("double").alias("_v"))
    counts = x.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    r = running_sums(counts, by, "_v", {"_n": "n"}, cuts=cut_points(x, "_v"))
    return r.select(*by, "_v", (F.col("cum_n") - (F.col("_n") - 1) / 2).alias(out))


def avg_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each row's value (1-based, ties averaged) without a global sort in one task."""
    x = df.withColumn("_v", F.col(value).cast("double"))
    return join_same(x, rank_table(df, value, out, by), [*by, "_v"]).drop("_v")


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences a - b."""
    d = pairs.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_m", F.abs("_d"))
    r = avg_rank(d, "_m", "_r")
    return r.agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
                 F.count(F.lit(1)).alias("n"))


# --- influence -----------------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, v: s + v)


def sum_vectors(df: DataFrame, by: Sequence[str], vec: str, out: str) -> DataFrame:
    """Element-wise sum of arrays per group: sums per (group, position), then one short array per group."""
    s = df.select(*by, F.posexplode(vec).alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum(F.col("_v").cast("double")).alias("_v"))
    packed = s.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
    return packed.select(*by, F.transform("_a", lambda t: t["_v"]).alias(out))


def influence(train: DataFrame, val: DataFrame, sample: str = "sample") -> DataFrame:
    """Sum over checkpoints of lr x <train gradient, summed validation gradient>.

    Validation gradients are added up first (one vector per checkpoint, a handful of rows), so
    train and validation samples are never paired.
    """
    v = sum_vectors(val, ["checkpoint"], "g", "_vg")
    j = join_small(train, v, ["checkpoint"], "inner")
    return j.groupBy(sample).agg(F.sum(F.col("lr") * dot("g", "_vg")).alias("influence"))


def projection_signs(dim: int, k: int, seed: int = 0) -> list[list[float]]:
    """k rows of random signs that depend on the seed only."""
    rng = random.Random(seed)
    return [[1.0 if rng.random() < 0.5 else -1.0 for _ in range(dim)] for _ in range(k)]


def project(vec: Column | str, dim: int, k: int, seed: int = 0) -> Column:
    """K random +-1 projections scaled by 1 / sqrt(k)."""
    scale = 1.0 / math.sqrt(k)
    return F.array(*[dot(vec, F.array(*map(F.lit, r))) * scale for r in projection_signs(dim, k, seed)])


def curate(df: DataFrame, score: str, share: float, mode: str = "drop", weight: float = 0.5) -> DataFrame:
    """Drop, or down-weight, the rows scoring below the ``share`` quantile."""
    cut = quantiles(df, [], score, [share]).select(F.struct("value").alias("c")).scalar()
    d = df.withColumn("_c", cut)
    low = F.col(score) < F.col("_c.value")
    if mode == "drop":
        return d.where(~low).drop("_c")
    return d.withColumn("weight", F.when(low, F.lit(weight)).otherwise(F.lit(1.0))).drop("_c")


def confident_joint(df: DataFrame, label: str, probs: str, classes: int) -> DataFrame:
    """Counts (given label, confident class); a class is confident above the mean self-confidence of its label."""
    own = F.try_element_at(F.col(probs), F.col(label) + 1)
    t = df.groupBy(label).agg(F.avg(own).alias("_t"))
    thr = only_row(t, F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_t")))).alias("m"))
    d = df.withColumn("_m", thr)
    score = lambda j: F.when(F.try_element_at(F.col(probs), F.lit(j + 1)) >= F.col("_m.m")[F.lit(j)], F.try_element_at(F.col(probs), F.lit(j + 1)))
    cand = F.array_compact(F.array(*[F.when(score(j).isNotNull(), F.struct(score(j).alias("p"), F.lit(-j).alias("j"))) for j in range(classes)]))
    best = F.array_max(cand)
    return d.withColumn("_b", best).where("_b IS NOT NULL").groupBy(F.col(label).alias("given"), (-F.col("_b.j")).alias("confident")).agg(F.count(F.lit(1)).alias("n"))


def active_select(df: DataFrame, influence_col: str, p: str, key: str, k: int, alpha: float = 0.5) -> DataFrame:
    """The k rows with the largest mix of negative influence and entropy."""
    e = -(F.col(p) * F.ln(p) + (1 - F.col(p)) * F.ln(1 - F.col(p)))
    s = alpha * -F.col(influence_col) + (1 - alpha) * e
    return df.withColumn("priority", s).orderBy(F.desc("priority"), key).limit(k)


def selection_recall(selected: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Share of the true set that was selected."""
    t = truth.select(key).distinct()
    hit = t.join(selected.select(key, F.lit(1).alias("_s")).distinct(), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("truth"), F.count("_s").alias("found"), F.try_divide(F.count("_s"), F.count(F.lit(1))).alias("recall"))


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap of two edit sets."""
    x = a.select(key, F.lit(1).alias("_a")).distinct().join(b.select(key, F.lit(1).alias("_b")).distinct(), key, "full")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return x.agg(both.alias("both"), F.count(F.lit(1)).alias("either"), F.try_divide(both, F.count(F.lit(1))).alias("jaccard"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two scores of the same rows."""
    x = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    # Both rank tables come from the rows themselves, neither from the other's join.
    ra, rb = (rank_table(x, c, out) for c, out in (("_a", "_ra"), ("_b", "_rb")))
    r = join_same(x.withColumn("_v", F.col("_a")), ra, ["_v"]).withColumn("_v", F.col("_b"))
    r = join_same(r, rb, ["_v"])
    return r.agg(F.corr("_ra", "_rb").alias("spearman"))


def sample_size(p: Column | str, margin: float, z: float = 1.96) -> Column:
    """Rows needed to know a share within a margin."""
    c = F.col(p) if isinstance(p, str) else p
    return F.ceil(c * (1 - c) * (z / margin) ** 2)


def consistency(deltas: DataFrame, scenario: str, delta: str) -> DataFrame:
    """Does each scenario's difference point the way the mean difference does."""
    overall = only_row(deltas, F.avg(delta).alias("m"))
    d = deltas.withColumn("_m", overall)
    return d.select(scenario, delta, (F.signum(delta) == F.signum("_m.m")).cast("int").alias("consistent"))
