"""Temporal splits, guardrails and sampling (inventory G)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .patterns import join_same, only_row, previous_value, running_sums


def split_by_year(month: Column | str, val_year: int = 2022, pair: tuple[int, int] = (2022, 2023)) -> Column:
    """G1: one of the two years validates, the other one tests, the rest trains."""
    test = pair[1] if val_year == pair[0] else pair[0]
    y = F.year(month)
    return F.when(y == val_year, "val").when(y == test, "test").otherwise("train")


def split_blocks(t: Column | str, stride: int) -> Column:
    """Repeating blocks of ``stride`` periods: validate, test, train."""
    k = F.pmod(F.col(t) if isinstance(t, str) else t, F.lit(3 * stride))
    return F.when(k < stride, "val").when(k < 2 * stride, "test").otherwise("train")


def split_next_year(
    samples: DataFrame, calendar: DataFrame, y0: int, y1: int, k: int, h_max: int,
    t_end: str = "t_end", t: str = "t", month: str = "month", exclude_val_from_train: bool = False,
) -> DataFrame:
    """Train on y0..y1 with ``t_end + h_max`` inside the training months, validate on the last k of
    those, test on y1 + 1.  A sample may be in train and val at once, as one row per split.
    """
    span = F.when(F.year(month).between(y0, y1), F.col(t))
    first_last = only_row(calendar, F.min(span).alias("lo"), F.max(span).alias("hi"))
    tests = F.when(F.year(month) == y1 + 1, F.col(t))
    test = only_row(calendar, F.min(tests).alias("lo"), F.max(tests).alias("hi"))
    s = samples.withColumn("_tr", first_last).withColumn("_te", test)
    x = F.col(t_end)
    cut = F.col("_tr.hi") - h_max
    in_train = (x >= F.col("_tr.lo")) & (x <= cut)
    in_val = in_train & (x >= cut - (k - 1))
    if exclude_val_from_train:
        in_train = in_train & ~in_val
    in_test = x.between(F.col("_te.lo"), F.col("_te.hi"))
    parts = F.array(F.when(in_train, "train"), F.when(in_val, "val"), F.when(in_test, "test"))
    return s.withColumn("split", F.explode(F.array_compact(parts))).drop("_tr", "_te")


def split_fixed(samples: DataFrame, stored: DataFrame, t_end: str = "t_end") -> DataFrame:
    """Split names stored per period."""
    return samples.join(stored.select(F.col("t").alias(t_end), "split"), t_end)


def walk_forward(
    samples: DataFrame, t_last: Column, h_max: int, first: Column, stride: int = 1, window: int = -1, val_window: int = 6, t_end: str = "t_end"
) -> DataFrame:
    """Rows keyed by origin.  Train and val need ``t_end + h_max <= origin``; score at the origin.

    Each sample lists the origins it serves (every ``stride`` from ``first`` to ``t_last``); for the
    counts of a fold aggregate by (origin, role) right away instead of storing the copies.
    """
    x = F.col(t_end)
    origins = F.sequence(first, t_last, F.lit(max(1, stride)))
    s = samples.withColumn("origin", F.explode(F.filter(origins, lambda o: o >= x)))
    o = F.col("origin")
    past = x + h_max <= o
    train = past & (F.lit(window < 0) | (x >= o - window + 1))
    val = past & (x >= o - val_window + 1)
    roles = F.array(F.when(train, "train"), F.when(val, "val"), F.when(x == o, "score"))
    return s.withColumn("role", F.explode(F.array_compact(roles)))


def mask_policy(samples: DataFrame, labels: DataFrame, keys: Sequence[str], policy: str = "all") -> DataFrame:
    """Keep samples whose labels are all (or any) valid over the horizons."""
    agg = F.min("m") if policy == "all" else F.max("m")
    ok = labels.groupBy(*keys).agg(agg.alias("_ok")).where("_ok = 1")
    return samples.join(ok, list(keys), "left_semi")


def dedup(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per sample key."""
    return samples.dropDuplicates(list(keys))


def choose_horizon(train: DataFrame) -> DataFrame:
    """The horizon with the most valid positives, the shortest one on a tie."""
    c = train.groupBy("horizon").agg(F.sum(F.col("y") * F.col("m")).alias("pos"))
    return c.agg(F.min_by("horizon", F.struct(-F.col("pos"), F.col("horizon"))).alias("horizon"), F.max("pos").alias("pos"))


def guardrail(train: DataFrame, entity: str, horizon: int, k: int, keep_if_empty: bool = True) -> DataFrame:
    """Drop entities with fewer than k valid positives; with ``keep_if_empty`` an empty result cancels the filter."""
    pos = train.where(F.col("horizon") == horizon).groupBy(entity).agg(F.sum(F.col("y") * F.col("m")).alias("_p"))
    good = pos.where(F.col("_p") >= k)
    if not keep_if_empty:
        return train.join(good, entity, "left_semi")
    any_good = only_row(pos, F.coalesce(F.max(F.col("_p")) >= k, F.lit(False)).alias("any"))
    marked = train.join(good.select(entity, F.lit(True).alias("_g")), entity, "left").withColumn("_a", any_good)
    return marked.where(F.col("_g").isNotNull() | ~F.col("_a.any")).drop("_g", "_a")


def class_weights(train: DataFrame, policy: str = "all", any_valid: str | None = None) -> DataFrame:
    """Positives weigh neg / max(pos, 1) of the valid rows, others 1; policy any zeroes rows without a valid label."""
    v = F.col("m") == 1
    c = only_row(train, F.sum((v & (F.col("y") == 1)).cast("bigint")).alias("p"), F.sum((v & (F.col("y") == 0)).cast("bigint")).alias("n"))
    w = F.when(F.col("y") == 1, F.col("_c.n") / F.greatest(F.col("_c.p"), F.lit(1))).otherwise(F.lit(1.0))
    if policy == "any" and any_valid:
        w = w * F.col(any_valid)
    return train.withColumn("_c", c).withColumn("w", w).drop("_c")


def uniform_of(seed: int, key: Column | str) -> Column:
    """A number from 0 to below 1 out of the first 52 bits of the MD5 of ``seed:key``."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """N draws with replacement, probability proportional to the weight; ``draws`` per chosen row.

    Without ``n`` there are as many draws as rows.  Rows become consecutive intervals of the running weight; hashed
    uniforms are looked up in them by a segmented look-back, so neither the rows nor the draws meet in one task.
    """
    spark = df.sparkSession
    src = df.where(F.col(weight) > 0).select(F.col(key).cast("bigint").alias("_k"), F.col(weight).cast("double").alias("_w"))
    cum = running_sums(src.withColumn("_x", F.col("_k").cast("double")), [], "_x", {"_w": "w"}, ["_k"])
    starts = cum.select((F.col("cum_w") - F.col("_w")).alias("_x"), F.lit(0).alias("_side"), F.col("_k"), F.col("_k").alias("_id"))
    total = only_row(src, F.sum("_w").alias("w"))
    ids = df.select(F.col(key).cast("bigint").alias("id")) if n is None else spark.range(n)
    draws = ids.withColumn("_t", total).select(
        (uniform_of(seed, "id") * F.col("_t.w")).alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_k"), F.col("id").alias("_id"))
    hit = previous_value(starts.unionByName(draws), [], "_x", ["_x", "_side", "_id"], "_k", "_pick", inclusive=True).where("_side = 1")
    picks = hit.groupBy(F.col("_pick").alias(key)).agg(F.count(F.lit(1)).alias("draws"))
    return df.join(picks, key)


def sample_k(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """Uniform sample of fixed size, the same on every run: the k smallest key hashes."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(k).drop("_h")


def pos_counts(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Valid cells and positives per group."""
    return labels.groupBy(*by).agg(F.sum("m").cast("bigint").alias("valid"), F.sum(F.col("y") * F.col("m")).cast("bigint").alias("pos"))


def split_summary(samples: DataFrame, horizons: Sequence[int], split: str = "split") -> DataFrame:
    """Distinct samples per split with valid and positive counts per horizon (long samples x horizon input)."""
    aggs = []
    for h in horizons:
        at = F.col("horizon") == h
        aggs += [F.sum(F.when(at, F.col("m"))).cast("bigint").alias(f"valid_h{h}"), F.sum(F.when(at, F.col("y") * F.col("m"))).cast("bigint").alias(f"pos_h{h}")]
    h0 = F.sum((F.col("horizon") == horizons[0]).cast("bigint")).alias("n")
    return samples.groupBy(split).agg(h0, *aggs)


def preflight_policy(counts: DataFrame, short_until: int = 2019) -> DataFrame:
    """Relaxed settings for short spans.

    Input per end year: ``end_year``, ``train_pos``, ``val_pos_min`` and ``val_pos_max`` over the horizons.
    """
    short = F.col("end_year") <= short_until
    none = short & (F.col("train_pos") == 0)
    return counts.withColumns({
        "mask_policy": F.when(short, "any").otherwise("all"),
        "sampler": F.when(short, "auto").otherwise("fixed"),
        "min_k": F.when(none, 0).when(short, 1).otherwise(2),
        "calibration": F.when(none | (short & (F.col("val_pos_max") < 5)), "none").otherwise("platt"),
    })


def lodo_splits(df: DataFrame, domain: str, domains: Sequence) -> DataFrame:
    """One copy per held-out domain, rows of that domain test, the rest trains."""
    out = df.withColumn("held_out", F.explode(F.array(*map(F.lit, domains))))
    return out.withColumn("split", F.when(F.col(domain) == F.col("held_out"), "test").otherwise("train"))


def leak_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys two sets share (must be 0)."""
    both = join_same(a.select(*keys).distinct(), b.select(*keys).distinct(), keys)
    return both.agg(F.count(F.lit(1)).alias("shared"))


def run_grid(spark, **axes: Sequence) -> DataFrame:
    """Every combination of the parameter lists, as a table."""
    df = spark.range(1).drop("id")
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def sample_index(ends: DataFrame, entity: str, t_end: str, horizons: Mapping | Sequence[int], window_len: int, h_min: int) -> DataFrame:
    """(win_idx, entity, h_idx, horizon, t_end) for all windows, entities and horizons."""
    hs = F.array(*[F.struct(F.lit(i).alias("h_idx"), F.lit(h).alias("horizon")) for i, h in enumerate(sorted(horizons))])
    s = ends.where(F.col(t_end) >= window_len - 1 + h_min).withColumn("_h", F.explode(hs))
    return s.select((F.col(t_end) - (window_len - 1 + h_min)).cast("int").alias("win_idx"), entity, "_h.h_idx", "_h.horizon", F.col(t_end).cast("int").alias(t_end))


