"""Thresholds, calibration, alerts and triage (inventory I)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.scalars import clamp, logit, sigmoid
from .metrics import budget_thresholds, observed, quantile_sweep
from .patterns import SEG, cut_points, join_same, join_small, previous_value, quantiles, with_segment
from .rolling import rolling_quantile

CANDIDATES = [i / 199 for i in range(200)]


def _best(preds: DataFrame, by: Sequence[str], gain: Column) -> DataFrame:
    """Candidate with the largest gain; the lowest threshold wins a tie."""
    s = quantile_sweep(preds, by, CANDIDATES).withColumn("_gain", gain)
    return s.groupBy(*by).agg(F.min_by("thr", F.struct(-F.col("_gain"), F.col("thr"))).alias("thr"))



def thr_f1(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best F1 among 200 evenly spaced score quantiles."""
    tp, fp, fn = F.col("at_pos"), F.col("at_n") - F.col("at_pos"), F.col("tot_pos") - F.col("at_pos")
    return _best(preds, by, 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)))


def thr_youden(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best true-positive minus false-positive rate."""
    neg = F.col("tot_n") - F.col("tot_pos")
    tpr = F.col("at_pos") / F.greatest("tot_pos", F.lit(1))
    return _best(preds, by, tpr - (F.col("at_n") - F.col("at_pos")) / F.greatest(neg, F.lit(1)))


def thr_cost(preds: DataFrame, by: Sequence[str], c_fn: float = 5.0, c_fp: float = 1.0) -> DataFrame:
    """Least cost of misses and false alarms."""
    cost = c_fn * (F.col("tot_pos") - F.col("at_pos")) + c_fp * (F.col("at_n") - F.col("at_pos"))
    return _best(preds, by, -cost)


def thr_budget(preds: DataFrame, by: Sequence[str], budget: float = 0.05) -> DataFrame:
    """I4: the (1 - b) quantile."""
    return budget_thresholds(preds, by, [budget]).drop("budget")


def thr_half(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return observed(preds).select(*by).distinct().withColumn("thr", F.lit(0.5))


POLICIES = {"f1": thr_f1, "youden": thr_youden, "cost": thr_cost, "budget": thr_budget, "half": thr_half}
EMPTY_DEFAULT = {"budget": 1.0}


def select_thresholds(preds: DataFrame, by: Sequence[str], policy: str = "budget", **kw) -> DataFrame:
    """Threshold per group under a named policy; groups without valid rows get the default."""
    found = POLICIES.get(policy, thr_half)(preds, by, **kw)
    groups = preds.select(*by).distinct()
    return join_same(groups, found, by, "left").na.fill({"thr": EMPTY_DEFAULT.get(policy, 0.5)})


def alerts(preds: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alert flag from thresholds fixed beforehand."""
    return join_small(preds, thresholds, by, "inner").withColumn("alert", (F.col("y_prob") >= F.col("thr")).cast("int"))


def alert_report(scored: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """Per group and period the threshold, rows, valid labels, onsets, alerts, and alerts that were right.

    ``scored`` carries the threshold of its group as ``thr``; without one nothing is alerted.
    """
    hit = F.coalesce(F.col("y_prob") >= F.col("thr"), F.lit(False))
    onset = (F.col("y_true") == 1) & (F.col("y_mask") == 1)
    return scored.groupBy(*by, period).agg(
        F.max("thr").alias("thr"), F.count(F.lit(1)).alias("n"), F.sum("y_mask").cast("bigint").alias("valid"),
        F.sum(F.col("y_true") * F.col("y_mask")).cast("bigint").alias("positives"), F.count_if(hit).alias("alerts"), F.count_if(hit & onset).alias("hits"))


# --- calibration ---------------------------------------------------------------------------


def _fit_platt(fit: DataFrame, link: str):
    n, pos = fit.agg(F.count(F.lit(1)), F.coalesce(F.sum("y_true"), F.lit(0))).first()
    if n < 20 or pos in (0, n):
        return None
    x = logit("y_prob") if link == "logit" else clamp("y_prob")
    rows = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(fit.select(F.col("y_true").cast("double").alias("_y"), x.alias("_x")))
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    return lr.fit(rows)


class Platt:
    """Logistic recalibration, L2 with C = 1; identity below 20 rows or with one class."""

    def __init__(self, link: str = "p"):
        self.link, self.model = link, None

    def fit(self, fit: DataFrame) -> "Platt":
        self.model = _fit_platt(observed(fit), self.link)
        return self

    def transform(self, p: Column | str) -> Column:
        if self.model is None:
            return F.col(p) if isinstance(p, str) else p
        x = logit(p) if self.link == "logit" else clamp(p)
        return sigmoid(F.lit(float(self.model.coefficients[0])) * x + F.lit(float(self.model.intercept)))


def _piecewise(c: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear between the knots, constant beyond them: a balanced tree of comparisons, log(n) per row."""

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            slope = (ys[hi] - ys[lo]) / (xs[hi] - xs[lo]) if xs[hi] > xs[lo] else 0.0
            return F.lit(ys[lo]) + (c - F.lit(xs[lo])) * F.lit(slope)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(xs[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    if len(xs) == 1:
        return F.when(c.isNotNull(), F.lit(ys[0]))
    return F.when(c <= F.lit(xs[0]), F.lit(ys[0])).when(c >= F.lit(xs[-1]), F.lit(ys[-1])).when(c.isNotNull(), tree(0, len(xs) - 1))


class Isotonic:
    """Monotone recalibration as a column, for models of few knots; :func:`isotonic_knots` has the table form.

    Constant beyond the fitted range.  Rows are first reduced to distinct scores (mean outcome, weight = count).
    """

    def __init__(self):
        self.points: tuple[list[float], list[float]] | None = None

    def fit(self, fit: DataFrame) -> "Isotonic":
        v = observed(fit)
        n, pos = v.agg(F.count(F.lit(1)), F.coalesce(F.sum("y_true"), F.lit(0))).first()
        if n >= 20 and pos not in (0, n):
            t = v.groupBy("y_prob").agg(F.avg("y_true").alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
            m = IsotonicRegression(featuresCol="y_prob", labelCol="_y", weightCol="_w").fit(
                VectorAssembler(inputCols=["y_prob"], outputCol="_f").transform(t).drop("y_prob").withColumnRenamed("_f", "y_prob")
            )
            self.points = (list(map(float, m.boundaries)), list(map(float, m.predictions)))
        return self

    def transform(self, p: Column | str) -> Column:
        c = F.col(p) if isinstance(p, str) else p
        if not self.points:
            return c
        return _piecewise(c, *self.points)


def pool(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Adjacent blocks (first score, last score, sum, weight) pooled until their means rise strictly."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        a, b, s, w = block
        while out and out[-1][2] * w >= s * out[-1][3]:
            a, _, s0, w0 = out.pop()
            s, w = s + s0, w + w0
        out.append([a, b, s, w])
    return [np.asarray(c, dtype=float) for c in zip(*out)] if out else [np.empty(0)] * 4


def _pooled(rows: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Blocks of ``rows`` (lo, hi, s, w) pooled within ``within``."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("lo").combine_chunks()
        blocks = pool(*(t.column(c).to_numpy() for c in ("lo", "hi", "s", "w")))
        first = pa.array(np.zeros(len(blocks[0]), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*(t.column(c).chunk(0).take(first) for c in within), *map(pa.array, blocks)], names=[*within, "lo", "hi", "s", "w"])

    return rows.groupBy(*within).applyInArrow(run, f"{kinds}, lo double, hi double, s double, w double")


def isotonic_knots(fit: DataFrame, by: Sequence[str]) -> DataFrame:
    """I7 as a table: knots (by, p, f) of the monotone fit of every group.

    Rows are first reduced to distinct scores.  Scores are pooled within segments, then the blocks that
    remain are pooled per group: pooling neighbours in any order ends at the same blocks, and only blocks
    meet in one task.  Groups with fewer than 20 rows or one class have no knots.
    """
    v = observed(fit)
    cells = v.groupBy(*by, F.col("y_prob").cast("double").alias("lo")).agg(F.sum(F.col("y_true").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    cells = with_segment(cells, "lo", cut_points(cells, "lo")).withColumn("hi", F.col("lo"))
    blocks = _pooled(_pooled(cells, by, [*by, SEG]), by, list(by))
    group = Window.partitionBy(*by)
    blocks = blocks.withColumns({"_n": F.sum("w").over(group), "_pos": F.sum("s").over(group)}).where("_n >= 20 AND _pos > 0 AND _pos < _n")
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select(*by, F.explode(ends).alias("p"), (F.col("s") / F.col("w")).alias("f"))


def apply_knots(df: DataFrame, knots: DataFrame, by: Sequence[str], p: str = "y_prob", out: str = "y_cal") -> DataFrame:
    """Linear between the knots of a row's group, constant beyond them, unchanged for groups without knots.

    Distinct scores look for the knots on either side by segmented look-back, then rows take their score's value.
    """
    scores = df.select(*by, F.col(p).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    both = scores.select(*by, "_x", F.lit(1).alias("_side"), F.lit(None).cast("struct<p:double,f:double>").alias("_k")).unionByName(
        knots.select(*by, F.col("p").alias("_x"), F.lit(0).alias("_side"), F.struct(F.col("p"), F.col("f")).alias("_k")))
    both = both.withColumn("_m", -F.col("_x"))
    both = previous_value(both, by, "_x", ["_x", "_side"], "_k", "_lo")
    both = previous_value(both, by, "_m", ["_m", "_side"], "_k", "_hi").where("_side = 1")
    between = F.col("_lo.f") + (F.col("_hi.f") - F.col("_lo.f")) * (F.col("_x") - F.col("_lo.p")) / (F.col("_hi.p") - F.col("_lo.p"))
    value = F.when(F.col("_lo").isNull(), F.coalesce("_hi.f", "_x")).when(F.col("_hi").isNull() | (F.col("_hi.p") == F.col("_lo.p")), F.col("_lo.f")).otherwise(between)
    table = both.select(*by, "_x", value.alias(out))
    rows = df.withColumn("_x", F.col(p).cast("double"))
    return join_same(rows, table, [*by, "_x"], "left").drop("_x")


class Identity:
    """I8."""

    def fit(self, fit: DataFrame) -> "Identity":
        return self

    def transform(self, p: Column | str) -> Column:
        return F.col(p) if isinstance(p, str) else p


def temperature_losses(preds: DataFrame, by: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Mean NLL per candidate temperature, one aggregation with one column per candidate."""
    v, y = observed(preds), F.col("y_true")
    cols = []
    for i, t in enumerate(grid):
        q = clamp(sigmoid(logit("y_prob") / F.lit(float(t))))
        cols.append(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias(f"_t{i}"))
    wide = v.groupBy(*by).agg(*cols)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_t{i}").alias("nll")) for i, t in enumerate(grid)])
    return wide.select(*by, F.inline(pairs))


def temperature_fit(preds: DataFrame, by: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Temperature of least NLL (the lower temperature wins a tie)."""
    return temperature_losses(preds, by, grid).groupBy(*by).agg(
        F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll")
    )


class Temperature:
    """I12 as a calibrator with one parameter."""

    def __init__(self, grid: Sequence[float] = tuple(0.25 * i for i in range(1, 21))):
        self.grid, self.t = grid, 1.0

    def fit(self, fit: DataFrame) -> "Temperature":
        row = temperature_fit(fit, [], self.grid).first()
        if row and row["temperature"] is not None:
            self.t = float(row["temperature"])
        return self

    def transform(self, p: Column | str) -> Column:
        return sigmoid(logit(p) / F.lit(self.t))


CALIBRATORS = {"none": Identity, "platt": Platt, "isotonic": Isotonic, "temperature": Temperature}


def calibrate(fit: DataFrame, apply: DataFrame, method: str = "platt", horizons: Sequence[int] = (1, 3), **kw) -> DataFrame:
    """One frozen calibrator per horizon (a short parameter list), applied pointwise as ``y_cal``.

    Rows of a horizon that is not listed fail, so that none stays uncalibrated unnoticed.
    """
    known = F.coalesce(F.col("horizon").isin(list(horizons)), F.lit(False))
    if method == "isotonic":
        checked = apply.withColumn("horizon", F.when(known, F.col("horizon")).otherwise(F.raise_error(F.lit("a horizon has no calibrator")).cast("int")))
        return apply_knots(checked, isotonic_knots(fit.where(known), ["horizon"]), ["horizon"])
    out = F.when(known, F.col("y_prob")).otherwise(F.raise_error(F.lit("a horizon has no calibrator")).cast("double"))
    for h in horizons:
        c = CALIBRATORS[method](**kw).fit(fit.where(F.col("horizon") == h))
        out = F.when(F.col("horizon") == h, c.transform("y_prob")).otherwise(out)
    return apply.withColumn("y_cal", out)


def calibration_window(preds: DataFrame, last: Column, months: int, month: str = "month") -> DataFrame:
    """Rows of the ``months`` months ending at ``last``."""
    return preds.where((F.col(month) > F.add_months(last, -months)) & (F.col(month) <= last))


def calib_fallback(preds: DataFrame, by: Sequence[str], last: Column, windows=(12, 18, 24), min_pos: int = 5, month="month") -> DataFrame:
    """Shortest window with enough positives in every group's validation rows, else none."""
    v = observed(preds)
    inside = lambda w: (F.col(month) > F.add_months(last, -w)) & (F.col(month) <= last)
    counts = v.groupBy(*by).agg(*[F.sum(F.when(inside(w), F.col("y_true")).otherwise(0)).alias(f"pos_{w}") for w in windows])
    pick = F.coalesce(*[F.when(F.col(f"pos_{w}") >= min_pos, F.lit(w)) for w in windows], F.lit(0))
    return counts.withColumn("window", pick).withColumn("method", F.when(F.col("window") > 0, "platt").otherwise("none"))


def cqr(fit: DataFrame, apply: DataFrame, by: Sequence[str], y: str, lo: str, hi: str, alphas: Sequence[float]) -> DataFrame:
    """Widen quantile bands by the (1 - alpha) quantile of the conformity residuals, per level."""
    res = fit.select(*by, F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)).alias("_r"))
    adj = quantiles(res, by, "_r", [1 - a for a in alphas])
    back = F.create_map(*[F.lit(x) for a in alphas for x in (1 - a, float(a))])
    adj = adj.select(*by, back[F.col("q")].alias("alpha"), F.col("value").alias("_adj"))
    return join_same(apply, adj, by).withColumns({f"{lo}_c": F.col(lo) - F.col("_adj"), f"{hi}_c": F.col(hi) + F.col("_adj")}).drop("_adj")


def cqr_rolling(df: DataFrame, by: Sequence[str], t: str, y: str, lo: str, hi: str, alpha: float, periods: int) -> DataFrame:
    """I13 on a panel: residual quantile over the ``periods`` periods before each row."""
    residual = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    r = rolling_quantile(df, by, t, residual, 1 - alpha, periods, "_a")
    return r.withColumns({f"{lo}_c": F.col(lo) - F.col("_a"), f"{hi}_c": F.col(hi) + F.col("_a")}).drop("_a")


def drift_alarm(metrics: DataFrame, by: Sequence[str], period: str, limit: float, name: str = "ece") -> DataFrame:
    """A period above the limit warns, two in a row ask for recalibration."""
    w = Window.partitionBy(*by).orderBy(period)
    over_ = (F.col(name) > limit).cast("int")
    return metrics.withColumn("over_limit", over_).withColumn(
        "recalibrate", ((F.col("over_limit") == 1) & (F.coalesce(F.lag("over_limit").over(w), F.lit(0)) == 1)).cast("int")
    )


def triage(history: DataFrame, latest: DataFrame, entity: str, min_auroc: float, k: int) -> DataFrame:
    """I16: the k entities with the highest current risk among those with a stable record."""
    ok = history.where(F.col("auroc") >= min_auroc).select(entity, "auroc")
    return latest.join(ok, entity).orderBy(F.desc("risk"), entity).limit(k)


def pareto(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Budgets whose hit rate beats every point with fewer (or equal) false alarms."""
    w = Window.partitionBy(*by).orderBy("fa_per_100", F.desc("hit"), "budget")
    best = F.max("hit").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return curve.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("hit") > F.col("_b"))).drop("_b")


def fit_surge_model(fit: DataFrame, apply: DataFrame, vector_cols: Sequence[str], label: str = "y", weight: str = "w", entity: str | None = None):
    """Logistic classifier over array features, optional one-hot entity, with row weights.

    Learned from ``fit`` alone; returns the model and the rows of ``apply`` with ``y_prob``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.functions import array_to_vector

    ins = [f"_v_{c}" for c in vector_cols]
    vectors = lambda df: df.withColumns({f"_v_{c}": array_to_vector(F.col(c)) for c in vector_cols})
    stages = []
    if entity:
        stages.append(OneHotEncoder(inputCols=[entity], outputCols=["_ent"], handleInvalid="keep"))
        ins.append("_ent")
    stages += [
        VectorAssembler(inputCols=ins, outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol=weight, regParam=0.01, maxIter=30),
    ]
    model = Pipeline(stages=stages).fit(vectors(fit))
    scored = model.transform(vectors(apply)).withColumn("y_prob", vector_to_array("probability")[1])
    return model, scored.drop(*ins, "_features", "rawPrediction", "probability", "prediction")
