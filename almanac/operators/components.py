"""Principal components from one summed matrix of centred products (inventory J3).

A task adds up the products of its vectors, taken from a shift that all tasks share, and hands on one
matrix; the matrices are summed by position with map-side combine.  What reaches the driver has the
size of the matrix, whatever the number of rows.  Wide vectors never make a full matrix: a few random
directions are multiplied by it, one scan a pass, until they span its leading components.

Defined results: a vector that is null, holds null or non-finite components, or has another length than
the first good one takes no part and gets null scores; without any good vector all scores are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Components:
    """``loadings`` (length x k) in order of their ``variances``, about ``mean``, from ``n`` vectors."""

    n: int
    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray


def good(vector: Column, length: int) -> Column:
    """Whether a vector has this length and finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == length) & ~bad, F.lit(False))


def summed(vectors: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``work`` (``size`` numbers) of the matrix of a batch's vectors (the only column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
                total += work(flat.reshape(b.num_rows, -1)).ravel()
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(size)
    for at, value in vectors.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def _signed(loadings: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest loading of each is positive."""
    if not loadings.size:
        return loadings
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return loadings * np.where(top < 0, -1.0, 1.0)


def components(df: DataFrame, vector: Column, k: int | None = 2, wide: int = 1024, extra: int = 8, passes: int = 6, seed: int = 0) -> Components:
    """The first ``k`` components (all, if None) of the vectors.

    Up to ``wide`` dimensions the matrix of products is summed in one scan.  Beyond, ``k + extra`` random
    directions are refined in ``passes`` scans: exact for components that stand out, close for others.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    some = df.select(v.alias("v")).where(F.expr("size(v) > 0"))
    first = some.where(good(F.col("v"), F.size("v"))).first()
    if first is None:
        return Components(0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    shift = np.array(first["v"])
    d = len(shift)
    rows = some.where(good(F.col("v"), d))
    k = min(k or d, d)
    if d <= wide:
        def products(x: np.ndarray) -> np.ndarray:
            y = np.hstack([np.ones((len(x), 1)), x - shift])
            return y.T @ y

        s = summed(rows, (d + 1) ** 2, products).reshape(d + 1, d + 1)
        n = int(round(s[0, 0]))
        off = s[0, 1:] / n
        values, directions = np.linalg.eigh(s[1:, 1:] / n - np.outer(off, off))
        top = np.argsort(-values, kind="stable")[:k]
        return Components(n, shift + off, _signed(directions[:, top]), np.maximum(values[top], 0.0))

    s = summed(rows, d + 1, lambda x: np.concatenate([[len(x)], (x - shift).sum(axis=0)]))
    n, mean = int(round(s[0])), shift + s[1:] / s[0]
    m = min(k + extra, d)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    for _ in range(passes):
        q = np.linalg.qr(summed(rows, d * m, lambda x, q=q: (x - mean).T @ ((x - mean) @ q)).reshape(d, m))[0]

    def inner(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ q
        return y.T @ y

    values, turn = np.linalg.eigh(summed(rows, m * m, inner).reshape(m, m) / n)
    top = np.argsort(-values, kind="stable")[:k]
    return Components(n, mean, _signed(q @ turn[:, top]), np.maximum(values[top], 0.0))


def scores(df: DataFrame, vector: Column, found: Components, prefix: str = "pc") -> DataFrame:
    """The input with the centred vector's product with each loading, ``pc1`` and so on."""
    d = len(found.mean)
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])

    def score(j: int) -> Column:
        terms = F.zip_with(F.transform(vector, lambda x: x.cast("double")), array(found.loadings[:, j]), lambda x, w: x * w)
        base = float(found.mean @ found.loadings[:, j])
        return F.when(good(vector, d), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) - base)

    return df.withColumns({f"{prefix}{j + 1}": score(j) for j in range(found.loadings.shape[1])})
