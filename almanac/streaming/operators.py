"""Structured Streaming operators (inventory N1-N6, N9, N10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import asof_join
from ..operators.patterns import only_row
from ..session import new_path


def tumble(stream: DataFrame, ts: str, size: str, watermark: str, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Tumbling aggregation; a window appears once the watermark has passed its end."""
    g = stream.withWatermark(ts, watermark).groupBy(F.window(ts, size), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggs)


def slide(stream: DataFrame, ts: str, size: str, step: str, watermark: str, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Sliding aggregation, each reading counts in size / step windows."""
    g = stream.withWatermark(ts, watermark).groupBy(F.window(ts, size, step), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggs)


def sessions(stream: DataFrame, ts: str, gap: str, watermark: str, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Item collection until nothing arrives for ``gap``.

    Where the session says so, sessions are merged inside each task before the shuffle, which thins out a hot key.
    """
    # Thinning out needs spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition, a session setting.
    g = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("s"), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return g.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, *aggs)


def enrich(stream: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Stream with a static dimension."""
    return stream.join(dim, list(on), how)


def dedupe_late(stream: DataFrame, key: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """One row per key within the watermark; later repeats and late rows are dropped."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))


def _alerts(min_len: int, refractory: int, lateness: int):
    """Run and refractory bookkeeping of one station, over its periods in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, length, last_t, accepted, seen, held = state.get if state.exists else (-1, 0, -1, -1, -1, "")
        waiting = dict(tuple(map(int, x.split(":"))) for x in held.split(",") if x)
        for rows in batches:
            for t, flag in zip(rows["t"].tolist(), rows["flag"].tolist()):
                if t > last_t:  # a period that was worked off already stays as it is
                    waiting[int(t)] = int(flag == 1)
                    seen = max(seen, int(t))
        out = []
        for t in sorted(x for x in waiting if x <= seen - lateness):
            if not waiting.pop(t):
                length = 0
            elif length and t == last_t + 1:
                length += 1
            else:
                start, length = t, 1
            if length == min_len and (accepted < 0 or start - accepted > refractory):
                accepted = start
                out.append(start)
            last_t = t
        state.update((start, length, last_t, accepted, seen, ",".join(f"{t}:{f}" for t, f in sorted(waiting.items()))))
        yield pd.DataFrame({"station": [key[0]] * len(out), "onset_t": out}, columns=["station", "onset_t"]).astype("int64")

    return step


def alert_state(stream: DataFrame, min_len: int, refractory: int, lateness: int = 0) -> DataFrame:
    """Onsets of runs of at least ``min_len`` flagged periods, refractory periods apart.

    Input rows: station, t (period ordinal, one row per station and period), flag.  A station's periods
    are worked off in order once one at least ``lateness`` later has come, so files may arrive out of
    order by that much; like behind a watermark, the last ``lateness`` periods wait, and what comes
    later still is left out.  The state is a few integers and at most the waiting periods; the batch
    twin is E10 followed by E11.
    """
    return stream.select("station", "t", "flag").groupBy("station").applyInPandasWithState(
        _alerts(min_len, refractory, lateness), "station bigint, onset_t bigint", "start bigint, length bigint, last_t bigint, accepted bigint, seen bigint, held string",
        "append", GroupStateTimeout.NoTimeout)


class MicroBatches:
    """Runs ``step(batch, batch_id)`` per micro-batch and keeps its output in per-batch folders.

    A folder is named after its batch and overwritten on a retry, so the log holds every batch
    exactly once.  With the same ``path`` and ``checkpoint`` a later run goes on where this one ended.
    """

    def __init__(self, step: Callable[[DataFrame, int], DataFrame], path: str | None = None, checkpoint: str | None = None):
        self.step, self.path, self.checkpoint = step, path, checkpoint

    def run(self, stream: DataFrame) -> DataFrame:
        spark = stream.sparkSession
        path = self.path or new_path(spark, "batches")
        checkpoint = self.checkpoint or new_path(spark, "batches-checkpoint")

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.persist()  # a step reads its batch several times
            try:
                self.step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            finally:
                batch.unpersist()

        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(path).drop("batch")


def log_sink(stream: DataFrame, decide_batch: Callable[[DataFrame], DataFrame], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Decisions with their reasons, logged per micro-batch."""
    return MicroBatches(lambda b, _: decide_batch(b), path, checkpoint).run(stream)


def with_state(
    stream: DataFrame, is_state: Column, by: Sequence[str], on: str, tie: str, value: str, ttl: float,
    store: str | None = None, path: str | None = None, checkpoint: str | None = None, delay: float = 0.0,
) -> DataFrame:
    """Each utterance with the latest state of its device, at most ``ttl`` old.

    Every micro-batch is an as-of join against its own state rows plus the last state per device
    carried over from the batch before, a table under ``store`` named after the batch it belongs to.
    A retried batch reads the same predecessor and overwrites its own table.  A state more than ``ttl``
    and ``delay`` (how far rows may be out of order) behind the newest row is not carried on.
    """
    spark = stream.sparkSession
    store = store or new_path(spark, "device-state")

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        cols = [*by, on, tie, value]
        states = batch.where(is_state).select(*cols)
        if batch_id > 0:
            states = states.unionByName(spark.read.parquet(f"{store}/{batch_id - 1}"))
        newest = states.groupBy(*by).agg(F.max(F.struct(on, tie, value)).alias("_s")).select(*by, "_s.*")
        now = only_row(batch.select(on).unionByName(states.select(on)), F.max(on).alias("t"))
        alive = newest.withColumn("_now", now).where(F.col(on) >= F.col("_now.t") - F.lit(ttl + delay)).drop("_now")
        alive.write.mode("overwrite").parquet(f"{store}/{batch_id}")
        return asof_join(batch.where(~is_state), states, by, on, tie, ttl, prefix="state_")

    return MicroBatches(step, path, checkpoint).run(stream)
