"""Exact top-k by inner product with the threshold algorithm.

Vectors are cut into shards of bounded size and queries into blocks; a task holds one shard and one
block.  It sorts the shard's values per dimension, and for each query goes down the lists: from the
top where the query's component is positive, from the bottom where it is negative.  Vectors met in a
list are scored whole.  What no list has shown yet scores at most the sum of the query's components
times the values the lists have reached; once the k-th best score is above that bound, the query is
done with the shard.  The k best of every shard are merged.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; of rows with the same id the smallest vector stays; shorter vectors count as ended by
zeros; an empty vector scores 0; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component) for the rows that take part."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    ok = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(whole)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    start = offsets[0]
    return [values[a - start : b - start] for a, b in zip(offsets[:-1], offsets[1:])]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        ids, scores = ids[near], scores[near]
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def threshold_search(ids: np.ndarray, shard: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, depth: int = 16, growth: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best rows of ``shard`` for every query."""
    n, width = shard.shape
    top = max(int(np.abs(shard).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * max(width, 1)
    exact = np.float64 if top < 2**53 else np.int64  # both exact; the first multiplies faster
    shard, queries = shard.astype(exact), queries.astype(exact)
    order = np.argsort(shard, axis=0, kind="stable").astype(np.int32)
    ranked = np.take_along_axis(shard, order, axis=0)
    for query_id, q in zip(query_ids.tolist(), queries):
        up, down = np.nonzero(q > 0)[0], np.nonzero(q < 0)[0]
        seen = ids == query_id  # the query's own row is no candidate
        best_ids, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=exact)
        reach = depth
        while True:
            reach = min(reach, n)
            met = np.zeros(n, dtype=bool)
            if len(up) + len(down) == 0 or reach == n:
                met[:] = True
            else:
                met[order[n - reach :, up].ravel()] = True
                met[order[:reach, down].ravel()] = True
            new = np.nonzero(met & ~seen)[0]
            if len(new):
                best_ids, best = best_of(np.concatenate([best_ids, ids[new]]), np.concatenate([best, shard[new] @ q]), k)
                seen |= met
            if seen.all():
                break
            bound = ranked[n - reach, up] @ q[up] + ranked[reach - 1, down] @ q[down]
            if len(best) == k and best[-1] > bound:
                break
            reach *= growth
        yield query_id, best_ids, best.astype(np.int64)


def search(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """Per query (rows of ``vectors`` where ``is_query`` holds) its k best other rows: query_id, rank, vec_id, score.

    ``vectors`` is the result of :func:`integer_vectors`.  Two counts reach the driver; every task
    holds at most about ``shard_rows`` vectors and ``query_rows`` queries.
    """
    v = materialise(vectors, "vectors").withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, asked = v.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // query_rows))
    place = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    rows = v.select("vec_id", "v", F.lit(False).alias("asks"), place(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asks = v.where("is_query").select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), place(blocks, 2).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, asks = [], [], []
        for b in batches:
            ids.append(b.column("vec_id").to_numpy())
            rows += matrix(b.column("v"))
            asks.append(b.column("asks").to_numpy(zero_copy_only=False))
        ids, asks = np.concatenate(ids), np.concatenate(asks)
        all_rows = padded(rows, max(map(len, rows), default=0))
        found = list(threshold_search(ids[~asks], all_rows[~asks], ids[asks], all_rows[asks], k)) if asks.any() and not asks.all() else []
        cols = [np.concatenate([np.full(len(i), q, dtype=np.int64) for q, i, _ in found] or [np.empty(0, np.int64)]), np.concatenate([i for _, i, _ in found] or [np.empty(0, np.int64)]), np.concatenate([s for *_, s in found] or [np.empty(0, np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    near = rows.unionByName(asks).groupBy("shard", "block").applyInArrow(run, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
