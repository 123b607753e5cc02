"""Onset alerts of stations in event time (inventory N3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "station bigint, onset_t bigint"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, which keyed state with timers needs.

    The caller's session stays as it is; its own settings of state stores and time zone hold in the new one.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


class Onsets(StatefulProcessor):
    """One station: periods wait in a map until the watermark has passed them, then move the run of flagged periods on.

    A timer stands at the earliest waiting period.  Once nothing waits, a timer ``keep_ms`` after the last
    period clears the state of a station that has fallen silent.
    """

    def __init__(self, min_len: int, refractory: int, keep_ms: int):
        self.min_len, self.refractory, self.keep_ms = min_len, refractory, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint", "flag int, at bigint")
        self.run = handle.getValueState("run", "start bigint, length bigint, last_t bigint, accepted bigint, last_at bigint")

    def _state(self) -> tuple:
        return tuple(self.run.get()) if self.run.exists() else (-1, 0, -1, -1, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_t, first = self._state()[2], None
        for batch in rows:
            for t, flag, at in zip(batch["t"].tolist(), batch["flag"].tolist(), batch["at"].tolist()):
                if t > last_t:  # a period that was worked off already stays as it is
                    self.waiting.updateValue((int(t),), (int(flag == 1), int(at)))
                    first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield pd.DataFrame({"station": pd.Series(dtype="int64"), "onset_t": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        start, length, last_t, accepted, last_at = self._state()
        held = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        out = []
        for t, flag, at in (x for x in held if x[2] <= now):
            self.waiting.removeKey((t,))
            if not flag:
                length = 0
            elif length and t == last_t + 1:
                length += 1
            else:
                start, length = t, 1
            if length == self.min_len and (accepted < 0 or start - accepted > self.refractory):
                accepted = start
                out.append(start)
            last_t, last_at = t, max(at, last_at)
        left = [x[2] for x in held if x[2] > now]
        if left:
            self.handle.registerTimer(int(min(left)))
        elif last_at >= 0 and now >= last_at + self.keep_ms:
            self.run.clear()
            last_t = -1
        else:
            self.handle.registerTimer(int(last_at + self.keep_ms))
        if last_t >= 0:
            self.run.update((start, length, last_t, accepted, last_at))
        yield pd.DataFrame({"station": [key[0]] * len(out), "onset_t": out}, columns=["station", "onset_t"]).astype("int64")

    def close(self) -> None:
        pass


def onset_alerts(stream: DataFrame, ts: str, delay: str, min_len: int, refractory: int, keep_days: float = 365.0) -> DataFrame:
    """Onsets of runs of at least ``min_len`` flagged periods, more than ``refractory`` periods apart.

    Input rows: station, t (period ordinal, one row per station and period), flag, and the period's event time
    ``ts``, which grows with t.  A period is worked off once the watermark, ``delay`` behind the newest row of any
    station, has reached it; rows that come later are left out, in whatever files and order the
    rest came.  ``keep_days`` after its last period a station is forgotten; with more days than
    ``refractory`` and ``min_len`` periods take, no onset depends on that.  The stream belongs to a :func:`state_session`.
    """
    rows = stream.withWatermark(ts, delay).select("station", "t", "flag", ts, F.unix_millis(ts).alias("at"))
    return rows.groupBy("station").transformWithStateInPandas(Onsets(min_len, refractory, int(keep_days * 86_400_000)), OUT, "Append", "EventTime")
