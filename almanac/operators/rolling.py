"""Quantiles along sliding windows (inventory I13, E21).

A series is cut into chunks that each bring along the rows their first windows reach back to, so a
long series is many tasks.  In a chunk the values are ranked once and written into a wavelet matrix:
one row of running counts per bit of the rank.  The k-th smallest of any window is then read off bit by
bit, for all windows at once: n log n in all, whatever the width of the window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .patterns import running_sums

#: Rows of a chunk beside those that its windows reach back to.
CHUNK = 1 << 16


class WaveletMatrix:
    """Order statistics of any stretch of a sequence of whole numbers from 0 to ``top - 1``."""

    def __init__(self, ranks: np.ndarray, top: int):
        self.bits = max(1, int(top - 1).bit_length())
        self.zeros, self.counts = [], []
        now = ranks
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.counts.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            self.zeros.append(int(self.counts[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the numbers at lo to hi - 1, for arrays of stretches."""
        lo, hi, k, out = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), dtype=np.int64)
        for zeros, counts in zip(self.zeros, self.counts):
            a, b = counts[lo], counts[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out = 2 * out + one
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out


def window_quantiles(x: np.ndarray, periods: int, q: float) -> np.ndarray:
    """Interpolated q-quantile of the numbers among the ``periods`` values before each value; NaN where there are none."""
    there = ~np.isnan(x)
    at = np.concatenate([[0], np.cumsum(there)])
    n = len(x)
    first = np.maximum(np.arange(n) - periods, 0)
    lo, hi = at[first], at[:n]
    out = np.full(n, np.nan)
    some = np.nonzero(hi > lo)[0]
    if len(some):
        values, ranks = np.unique(x[there], return_inverse=True)
        m = WaveletMatrix(ranks.reshape(-1).astype(np.int64), len(values))
        lo, hi = lo[some], hi[some]
        place = q * (hi - lo - 1)
        k = np.floor(place).astype(np.int64)
        a, b = values[m.smallest(lo, hi, k)], values[m.smallest(lo, hi, np.ceil(place).astype(np.int64))]
        out[some] = a + (b - a) * (place - k)
    return out


def rolling_quantile(df: DataFrame, by: Sequence[str], t: str, value: Column | str, q: float, periods: int, out: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the q-quantile of the non-null values of the ``periods`` rows before each row of its key, by ``t``.

    Null where these hold no value.  ``t`` is numeric and unique in a key; a key of any length is cut into chunks.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    keyed = df.withColumns({"_value": value.cast("double"), "_one": F.lit(1).cast("long"), "_t": F.col(t).cast("double")})
    placed = running_sums(keyed, by, "_t", {"_one": "one"}, [t]).withColumn("_at", F.col("cum_one") - 1).drop("cum_one", "tot_one", "_one")
    size = max(chunk, periods)
    own = F.floor(F.col("_at") / F.lit(size))
    # The last ``periods`` rows of a chunk are looked back at from the next one.
    also = F.when(F.pmod("_at", F.lit(size)) >= size - periods, F.array(own, own + 1)).otherwise(F.array(own))
    narrow = placed.select(F.struct(*by).alias("_key") if by else F.lit(0).alias("_key"), F.col("_at").alias("_p"), F.col("_value").alias("_x"), F.explode(also).alias("_chunk"))
    kind = narrow.schema["_key"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_p")
        p = rows.column("_p").to_numpy()
        found = window_quantiles(rows.column("_x").to_numpy().astype(float), periods, q)
        mine = p // size == key[1].as_py()
        cols = [pa.repeat(key[0], int(mine.sum())), pa.array(p[mine]), pa.array(found[mine], from_pandas=True)]
        return pa.table(cols, names=["_key", "_p", "_q"])

    found = narrow.groupBy("_key", "_chunk").applyInArrow(run, f"_key {kind}, _p long, _q double")
    mine = placed.withColumn("_key", F.struct(*by) if by else F.lit(0))
    found = found.withColumnRenamed("_key", "_k")
    j = mine.join(found, mine._key.eqNullSafe(found._k) & (mine._at == found._p))
    return j.select(*df.columns, F.col("_q").alias(out))
