"""Joins of two streams in event time (inventory N6, N11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def latest_state(events: DataFrame, states: DataFrame, by: Sequence[str], ts: str, key: str, ttl: str, delay: str, values: Sequence[str], prefix: str = "state_") -> DataFrame:
    """Every event with the latest state of its device that is at most ``ttl`` old, or with none.

    Both streams have the columns ``by``, the event time ``ts`` and a unique ``key``, which orders equal
    times.  The range on event time bounds what either side keeps: states leave ``ttl`` after the
    watermark, events when the watermark passes them; nothing is rewritten per batch.  An event comes out
    once, when the watermark (``delay`` behind the slower stream) is ``ttl`` past it: until then the join
    may still hand on matches of that time.
    """
    e = events.withWatermark(ts, delay)
    s = states.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(ts).alias("_at"), F.struct(F.col(ts).alias("at"), *[F.col(c) for c in dict.fromkeys([key, *values])]).alias("_state")).withWatermark("_at", delay)
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    near = (F.col("_at") <= F.col(ts)) & (F.col("_at") >= F.col(ts) - F.expr(f"INTERVAL {ttl}"))
    cond = near
    for c in same:
        cond = cond & c
    j = e.join(s, cond, "leftOuter")
    best = j.groupBy(*events.columns).agg(F.max("_state").alias("_best"))
    return best.select(*events.columns, *[F.col(f"_best.{c}").alias(f"{prefix}{c}") for c in dict.fromkeys([key, *values])])


def partner_trigger(utterances: DataFrame, cycles: DataFrame, by: Sequence[str], ts: str, key: str, window: str, delay: str, lower_by: float) -> DataFrame:
    """The end of a cycle lowers the threshold ``theta`` of its partner's utterances for a time window."""
    j = latest_state(utterances, cycles, by, ts, key, window, delay, [], prefix="trg_")
    return j.withColumn("theta", F.col("theta") - F.when(F.col(f"trg_{key}").isNotNull(), F.lit(lower_by)).otherwise(0.0))
