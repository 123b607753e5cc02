"""Decision rules over matched scores (inventory N7, N8, N11, N12).

Plain DataFrame functions: they run on batches and inside ``foreachBatch`` alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import asof_join


def best_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest active and defensive score per event and device."""
    at = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return scored.groupBy(*keys).agg(at("active").alias("s_act"), at("defensive").alias("s_def"))


def decide(scores: DataFrame, theta_act: Column, theta_def: Column, delta: float) -> DataFrame:
    """N7, in this order: execute, stay silent, confirm, nothing."""
    a, d = F.col("s_act"), F.col("s_def")
    rule = (
        F.when(a >= theta_act, "execute")
        .when((d - a >= delta) & (d >= theta_def), "reject")
        .when(F.abs(d - a) < delta, "confirm")
        .otherwise("none")
    )
    return scores.withColumn("decision", rule)


def route(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """An executed command goes to a device of its family in the same room, else through the hub, else nowhere."""
    inv = inventory.groupBy("home", "family").agg(F.collect_set("room").alias("_rooms"))
    j = decisions.join(inv, ["home", "family"], "left")
    where = (
        F.when(F.col("decision") != "execute", F.lit(None))
        .when(F.array_contains("_rooms", F.col("room")), "local")
        .when(F.col("_rooms").isNotNull(), "hub")
    )
    return j.withColumn("target", where).drop("_rooms")


def trigger(utterances: DataFrame, state_events: DataFrame, by: Sequence[str], window_us: float, lower_by: float) -> DataFrame:
    """An end-of-cycle event lowers the threshold of its partner for a time window."""
    j = asof_join(utterances, state_events.select(*by, "us", "event_id"), by, "us", "event_id", window_us, prefix="trg_")
    return j.withColumn("theta", F.col("theta") - F.when(F.col("trg_event_id").isNotNull(), F.lit(lower_by)).otherwise(0.0))


def profile_weight(cands: DataFrame, profiles: DataFrame, default: float = 1.0) -> DataFrame:
    """Known speakers weigh the scores of their language, others get the household default."""
    j = cands.join(profiles, ["profile", "lang"], "left")
    return j.withColumn("score", F.col("score") * F.coalesce(F.col("weight"), F.lit(default))).drop("weight")
