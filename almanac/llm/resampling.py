"""Importance resampling towards a target distribution, on hashed word features.

An untrained ``Split`` of the tokenizers library cuts the ASCII-lowered text into words with offsets.
Windows over consecutive offset pairs name the runs of words; a run, its words joined by one space, falls
into the bucket of its CRC-32.  A table's histogram counts its features by bucket; a bucket's gain is a
thousand times the log of its smoothed share in the target over its share in the table, rounded down.
A text's weight is the sum of the gains of its features, and its score adds a Gumbel draw out of a hash
of its id, so the highest scores are a draw without replacement.

Texts are cut once: the buckets of a text are kept as packed numbers, two bytes a feature (four with
more than 65,536 buckets), and both the histogram and the weights read those.  Ranks come from segments of the score.

Defined results: a null or empty text has no features and weight 0; a null id hashes like an empty one;
rows that repeat an id have the same draw; equal scores go by id (nulls last), then by weight and number
of features; rows equal in all of these take consecutive ranks in any order.  An empty table gives an
empty result; an empty target counts no feature, so the gains favour rare buckets.  Other columns are ignored,
whatever their names.  Very long texts are cut into stretches between words, so a task holds the words
of ``STRETCH`` code points at a time and the packed buckets of one text.

Bounds: the histogram has ``buckets`` rows, a parameter; it alone goes through the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, pre_tokenizers

from ..operators.patterns import global_index
from .common import CRC_TABLE, crc_sql, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A character that is in no word; texts are cut there.
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
STRETCH = 1 << 20
LOWER = {i: i + 32 for i in range(65, 91)}


def splitter() -> pre_tokenizers.PreTokenizer:
    """Keeps the words and drops what is between them; nothing is trained."""
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``STRETCH`` code points that end between words."""
    at = 0
    while len(text) - at > STRETCH:
        cut = BETWEEN.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def features(text: str | None, split: pre_tokenizers.PreTokenizer, least: int, most: int, buckets: int) -> tuple[int, list[int]]:
    """Number of words, and the bucket of every run of ``least`` to ``most`` consecutive words."""
    words, out, tail = 0, [], []
    for part in stretches((text or "").translate(LOWER)):
        found = split.pre_tokenize_str(part)
        words += len(found)
        if most == 1:
            out += [zlib.crc32(w.encode()) % buckets for w, _ in found]
            continue
        # The last words of the stretch before open windows that end here.
        run = tail + [part[a:b] for _, (a, b) in found]
        for n in range(least, most + 1):
            for i in range(max(0, len(tail) - n + 1), len(run) - n + 1):
                out.append(zlib.crc32(" ".join(run[i : i + n]).encode()) % buckets)
        tail = run[len(run) - most + 1 :] if len(run) >= most else run
    return words, out


def packed(rows: DataFrame, key: str, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """(key, n_words, packed): the buckets of all features of a text as little-endian numbers, written."""
    kind, width = rows.schema[key].dataType.simpleString(), "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for b in batches:
            words, lists = [], []
            for t in b.column(1):
                n, found = features(t.as_py(), split, least, most, buckets)
                words.append(n)
                lists.append(np.asarray(found, dtype=width).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(lists, pa.binary())], names=["key", "n_words", "packed"])

    return materialise(rows.select(F.col(key).alias("key"), F.col(text_col).cast("string")).mapInArrow(run, f"key {kind}, n_words long, packed binary"), "features")


def histogram(cut: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket; a task sends one row per bucket at most."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=width), minlength=buckets)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in cut.select("packed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), in doubles."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.asarray([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist())], dtype=np.int64)


def gumbel(key: object, seed: int) -> int:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) of the first 32 bits of the SHA-256 of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank where it is drawn.

    Of the N documents with at least ``least_words`` words the floor(percent N / 100) highest scores are drawn.
    """
    cut = packed(docs, id_col, text_col, least, most, buckets)
    gain = gains(histogram(cut, buckets), histogram(packed(target, target_id, target_text, least, most, buckets), buckets))
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, dtype=width) for x in b.column(2).to_pylist()]
            weight = np.asarray([gain[f].sum() for f in found], dtype=np.int64)
            noise = np.asarray([gumbel(k, seed) for k in b.column(0).to_pylist()], dtype=np.int64)
            n = np.asarray([len(f) for f in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = cut.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")
    scored = materialise(scored.withColumn("_down", -F.col("score")), "scores")
    eligible, rest = scored.where(F.col("n_words") >= least_words), scored.where(F.col("n_words") < least_words)
    drawn = eligible.count() * percent // 100
    # An integer id also cuts stretches of equal scores; nulls last.
    tie = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if kind in ("bigint", "int", "smallint", "tinyint") else F.lit(0)
    ranked = global_index(eligible.withColumn("_tie", tie), "_down", ["_down", "_tie", F.col("doc_id").asc_nulls_last(), "weight", "n_features"], "idx")
    names = ["doc_id", "n_features", "weight", "score"]
    top = ranked.select(*names, F.when(F.col("idx") < drawn, F.col("idx") + 1).cast("long").alias("rank"))
    return top.unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))




RESAMPLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS ws FROM low),
raw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM cut) GROUP BY 1),
aim AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS w FROM benchmark) GROUP BY 1),
coded AS (SELECT w, {crc_sql('h')} % 10000 AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM raw UNION SELECT w FROM aim)), crc_table),
s AS (SELECT b, sum(n) AS n FROM raw JOIN coded USING (w) GROUP BY 1),
t AS (SELECT b, sum(n) AS n FROM aim JOIN coded USING (w) GROUP BY 1),
total AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
gain AS (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), total),
place AS (SELECT *, row_number() OVER () AS r FROM cut),
weighed AS (SELECT r, sum(g) AS weight FROM (SELECT r, unnest(ws) AS w FROM place) JOIN coded USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM place LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS k, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= drawn THEN k END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
