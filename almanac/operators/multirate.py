"""Daily, weekly and monthly sources, graphs and hierarchies (inventory M)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .draws import uniforms
from .dyadic import Axis, interval_join
from .patterns import join_same, previous_value, running_sums
from .timeseries import rolling


def multirate_features(daily: DataFrame, by: str, day: str, value: str, low: float) -> DataFrame:
    """M1: daily level and low-water days, aggregated to weeks and months, monthly rows with weekly extremes."""
    d = daily.withColumn("_m7", rolling(value, 7, by, day)).withColumn("_low", (F.col(value) < low).cast("int"))
    week = d.groupBy(by, F.date_trunc("WEEK", day).cast("date").alias("week")).agg(
        F.avg("_m7").alias("level"), F.sum("_low").alias("low_days"), F.count(value).alias("days"))
    month = F.trunc("week", "MM").alias("month")
    return week.groupBy(by, month).agg(
        F.avg("level").alias("mean_level"), F.min("level").alias("worst_week"), F.sum("low_days").alias("low_days"), F.sum("days").alias("days"))


def seq_samples(df: DataFrame, by: Sequence[str], t: str, past: int, ahead: int, known: str, observed: str, target: str) -> DataFrame:
    """M2: per anchor the last ``past`` observed values, the known ones over past + ahead, the targets ahead."""
    w = Window.partitionBy(*by).orderBy(t)
    back, fwd, both = w.rowsBetween(-(past - 1), 0), w.rowsBetween(1, ahead), w.rowsBetween(-(past - 1), ahead)
    s = df.select(*by, t, F.collect_list(observed).over(back).alias("observed"), F.collect_list(known).over(both).alias("known"),
                  F.collect_list(target).over(fwd).alias("target"))
    return s.where((F.size("observed") == past) & (F.size("known") == past + ahead) & (F.size("target") == ahead))


def diffuse(edges: DataFrame, x: DataFrame, rounds: int) -> DataFrame:
    """M3: (D_out^-1 A)^k x along and against the edges, k < rounds; edges (src, dst, w), x (node, x).

    Each round is one equi-join and one sum, so the cost is rounds x edges.
    """
    def walk(a, b, out):
        deg = edges.groupBy(a).agg(F.sum("w").alias("_d"))
        step = edges.join(deg, a).select(F.col(a).alias("node"), F.col(b).alias("_to"), (F.col("w") / F.col("_d")).alias("_p"))
        cur, parts = x.select("node", F.col("x").alias(out)), []
        for k in range(rounds):
            parts.append(cur.withColumn("k", F.lit(k)))
            nxt = step.join(cur.withColumnRenamed("node", "_to"), "_to")
            cur = nxt.groupBy("node").agg(F.sum(F.col("_p") * F.col(out)).alias(out))
        res = parts[0]
        for p in parts[1:]:
            res = res.unionByName(p)
        return res

    return walk("src", "dst", "forward").join(walk("dst", "src", "backward"), ["node", "k"], "full")


def edges_from_order(nodes: DataFrame, by: Sequence[str], node: str, mile: str) -> DataFrame:
    """M4: directed edge from every node to the next one downstream (descending mile)."""
    n = nodes.withColumn("_k", F.col(mile).cast("double")).withColumn("_s", F.struct(F.col(node).alias("n"), F.col(mile).alias("m")))
    e = previous_value(n.withColumn("_neg", -F.col("_k")), by, "_neg", ["_neg", node], "_s", "_up").where("_up IS NOT NULL")
    return e.select(*by, F.col("_up.n").alias("src"), F.col(node).alias("dst"), (F.col("_up.m") - F.col(mile)).alias("miles"))


def reconcile(base: DataFrame, parent: Sequence[str], value: str, var: str, total: str, total_var: str) -> DataFrame:
    """M5: one level reconciled with diagonal weights.

    The gap between the parent's own forecast and the sum of the children is shared out in
    proportion to the variances; an infinitely uncertain parent (null variance) is bottom-up.
    """
    w = base.groupBy(*parent).agg(F.sum(value).alias("_s"), F.sum(var).alias("_v"), F.max(total).alias("_t"), F.max(total_var).alias("_tv"))
    j = join_same(base, w, parent)
    share = F.coalesce(F.try_divide(F.col(var), F.col("_tv") + F.col("_v")), F.lit(0.0))
    return j.withColumn("reconciled", F.col(value) + share * F.coalesce(F.col("_t") - F.col("_s"), F.lit(0.0))).drop("_s", "_v", "_t", "_tv")


def coherency(children: DataFrame, parents: DataFrame, keys: Sequence[str], value: str, total: str, tol: float) -> DataFrame:
    """M6: parents whose children do not add up."""
    s = children.groupBy(*keys).agg(F.sum(value).alias("bottom"))
    j = join_same(parents.select(*keys, total), s, keys, "left").withColumn("gap", F.col(total) - F.coalesce("bottom", F.lit(0.0)))
    return j.where(F.abs("gap") > tol * F.greatest(F.abs(F.col(total)), F.lit(1.0)))


def stack_inverse_error(history: DataFrame, apply: DataFrame, models: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """M7: weights proportional to 1 / mean squared error in the history."""
    w = history.groupBy(*by).agg(*[F.avg(F.pow(F.col(m) - F.col(y), F.lit(2.0))).alias(f"_e_{m}") for m in models])
    j = join_same(apply, w, by)
    inv = {m: F.try_divide(F.lit(1.0), F.col(f"_e_{m}")) for m in models}
    num = sum((inv[m] * F.col(m) for m in models), F.lit(0.0))
    return j.withColumn("stacked", num / sum(inv.values(), F.lit(0.0))).drop(*[f"_e_{m}" for m in models])


def stack_linear(history: DataFrame, apply: DataFrame, models: Sequence[str], y: str) -> DataFrame:
    """M7: least-squares weights of the base forecasts (normal equations on the cluster)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    va = VectorAssembler(inputCols=list(models), outputCol="_f", handleInvalid="skip")
    lr = LinearRegression(featuresCol="_f", labelCol=y, predictionCol="stacked", solver="normal").fit(va.transform(history.where(F.col(y).isNotNull())))
    return lr.transform(va.transform(apply)).drop("_f")


def propagate(bands: DataFrame, by: Sequence[str], key: Sequence[str], qs: Sequence[tuple[float, str]], draws: int, out_qs: Sequence[float], seed: int = 0) -> DataFrame:
    """M8: Monte-Carlo sums of banded values per group: hashed uniforms through each row's quantile band.

    ``qs`` lists (level, column) in ascending order; draws beyond the outer levels take those values.
    Rows with a missing band value add nothing.
    """
    kinds = ", ".join(f"{c} {bands.schema[c].dataType.simpleString()}" for c in by)
    levels = [float(level) for level, _ in qs]
    rows = bands.select(*by, F.xxhash64(*[F.col(k) for k in key], F.lit(seed)).alias("_k"), F.array(*[F.col(c).cast("double") for _, c in qs]).alias("_band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task sums its rows before anything is sent: one vector per group and batch of rows.
        for b in batches:
            rows = b.num_columns - 2
            names = [tuple(x) for x in zip(*(b.column(i).to_pylist() for i in range(rows)))] if rows else [()] * b.num_rows
            band = np.asarray([x if x is not None else [np.nan] * len(levels) for x in b.column(rows + 1).to_pylist()], dtype=float).reshape(-1, len(levels))
            keys, first, sums = b.column(rows).to_numpy(), {}, {}
            for lo in range(0, len(keys), 1000):
                u = uniforms(keys[lo : lo + 1000], draws)
                i = np.clip(np.searchsorted(levels, u, side="right") - 1, 0, max(0, len(levels) - 2))
                x, edge = band[lo : lo + 1000], np.asarray(levels)
                left = np.take_along_axis(x, i, axis=1)
                if len(levels) > 1:
                    share = np.clip((u - edge[i]) / (edge[i + 1] - edge[i]), 0, 1)
                    left = left + (np.take_along_axis(x, i + 1, axis=1) - left) * share
                for r, name in enumerate(names[lo : lo + 1000]):
                    if not np.isnan(x[r]).any():
                        first.setdefault(name, lo + r)
                        sums[name] = sums.get(name, 0.0) + left[r]
            at = pa.array(list(first.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(rows)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=[*by, "sums"])

    some = rows.mapInArrow(run, ", ".join(filter(None, [kinds, "sums array<double>"])))
    sums = some.select(*by, F.posexplode("sums").alias("draw", "_s")).groupBy(*by, "draw").agg(F.sum("_s").alias("_s"))
    p = F.percentile("_s", F.array(*[F.lit(float(q)) for q in out_qs]))  # one row per draw
    return sums.groupBy(*by).agg(p.alias("_q")).select(*by, *[F.col("_q")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(out_qs)])


def shift_scenario(df: DataFrame, col: str, t: str, start: int, n: int, by_units: float = 1.0) -> DataFrame:
    """Counterfactual copy with ``col`` raised for n periods from ``start``."""
    hit = (F.col(t) >= start) & (F.col(t) < start + n)
    return df.withColumn(col, F.when(hit, F.col(col) + by_units).otherwise(F.col(col)))


def sessionise(df: DataFrame, by: Sequence[str], us: str, key: str, gap_us: float) -> DataFrame:
    """Session ordinal per key: a new one starts after a gap of more than ``gap_us`` (hot keys are segmented)."""
    d = df.withColumn("_x", F.col(us).cast("double"))
    d = previous_value(d, by, "_x", ["_x", key], us, "_prev")
    d = d.withColumn("_new", (F.col("_prev").isNull() | (F.col(us) - F.col("_prev") > gap_us)).cast("bigint"))
    s = running_sums(d, by, "_x", {"_new": "new"}, ["_x", key])
    return s.withColumn("session", F.col("cum_new")).drop("_x", "_prev", "_new", "cum_new", "tot_new")


def call_features(pings: DataFrame, gap_us: float, min_dwell_h: float) -> DataFrame:
    """Per vessel and week: calls, dwell hours, reports per call and mean move per hour.

    ``pings``: vessel, us, ping_id, week, pos.
    """
    s = sessionise(pings, ["vessel"], "us", "ping_id", gap_us)
    hours = (F.max("us") - F.min("us")) / F.lit(3.6e9)
    call = s.groupBy("vessel", "session").agg(
        F.min("week").alias("week"), hours.alias("dwell"), F.count(F.lit(1)).alias("reports"), (F.max("pos") - F.min("pos")).alias("span"))
    return call.groupBy("vessel", "week").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("dwell").alias("dwell_hours"), F.sum("reports").alias("reports"),
        F.sum((F.col("dwell") >= min_dwell_h).cast("int")).alias("queued"), F.avg(F.try_divide(F.col("span"), F.col("dwell"))).alias("speed"))


def episode_severity(events: DataFrame, segments: DataFrame, lag_days_per_mile: float) -> DataFrame:
    """Severity of an event at a segment downstream: falls with the miles and arrives later.

    ``events`` (event, mile, day, severity, reach); ``segments`` (segment, mile).  An event's miles are dyadic blocks, so a
    long reach costs a few rows.
    """
    e = events.withColumn("_end", F.col("mile") + F.col("reach"))
    j = interval_join(segments.select("segment", F.col("mile").alias("seg_mile")), e, [Axis("seg_mile", "mile", "_end")])
    dist = F.col("seg_mile") - F.col("mile")
    return j.select("event", "segment", F.date_add("day", F.floor(dist * lag_days_per_mile).cast("int")).alias("day"),
                    (F.col("severity") * (1 - dist / (F.col("reach") + 1))).alias("severity"))


def index_to_base(df: DataFrame, by: Sequence[str], value: str, is_base) -> DataFrame:
    """Value relative to the mean of the base period (= 100)."""
    base = df.where(is_base).groupBy(*by).agg(F.avg(value).alias("_b"))
    return join_same(df, base, by, "left").withColumn("index", 100 * F.try_divide(F.col(value), F.col("_b"))).drop("_b")


