"""Random draws that follow from hashed keys, vectorised over replicates.

A draw depends on its key, its number and a seed, so a task that runs again draws the same.
"""

from __future__ import annotations

import math

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniforms(keys: np.ndarray, draws: int) -> np.ndarray:
    """Uniform numbers in [0, 1), one row per key (64-bit hashes) and one column per draw."""
    x = np.ascontiguousarray(keys).view(np.uint64)[:, None] + GOLDEN * np.arange(1, draws + 1, dtype=np.uint64)[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson_table(mean: float) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below the spacing of uniform numbers."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1 - 2.0**-53 and k < 40 + 4 * mean:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return np.asarray(out)


def poisson(keys: np.ndarray, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Poisson numbers with the mean ``sizes`` of each key, by inversion; large means are cut into parts of at most 256."""
    out = np.zeros((len(keys), draws))
    tables: dict[int, np.ndarray] = {}
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        rest, part = int(size), 0
        while rest > 0:
            mean = min(rest, 256)
            if mean not in tables:
                tables[mean] = poisson_table(float(mean))
            salt = keys[at].astype(np.int64).view(np.uint64) + np.uint64(part * 7_046_029_254_386_353_131 % 2**64)
            out[at] += np.searchsorted(tables[mean], uniforms(salt, draws), side="right")
            rest, part = rest - mean, part + 1
    return out
