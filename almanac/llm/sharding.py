"""Random order and shards of a whole table by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash of id and text; there are as many buckets as
the table has memory-sized pieces, so a bucket fits into one task.  Pass two brings the rows of a bucket
into the order of their hashes, shuffles them with Fisher and Yates' exchange under a seed of the bucket,
and writes them.  The buckets in turn, each in its shuffled order, are the order of the table; shard s
holds the s-th of ``shards`` equal stretches of it (law ``rows``: counts differ by one at most).

The counts of the buckets come from a narrow first scan, so a bucket knows the place of its first row
and writes its rows straight into the folder of their shard.  The order depends on the rows, the seed and
the number of buckets alone: neither on the input's partitions nor on which task runs again.

Defined results: a null text has no bytes; a null id hashes by its text; rows that are equal in id and
text would meet in one bucket however many they are, so they are written first with a salt of their own
and then scattered like any others (only which of them comes first may change between runs).  Groups,
that is equal texts under different ids, are spread like all rows.  An empty table gives an empty result
without files.  All columns are kept; an input column called ``shard`` or ``slot`` becomes ``shard_input``
or ``slot_input``.  A text beyond ``bucket_bytes`` makes its bucket as large as itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, new_path, partitions
from .neighbours import grouped

#: Bytes that every record has besides its text.
RECORD = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and the record's own."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + F.lit(RECORD)).cast("long")


def quotient(x: Column, n: int) -> Column:
    """Whole quotient of a number that is not negative."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def exchange_order(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order that Fisher and Yates' exchange gives n rows: place i swaps with one of the places 0 to i, from the last down."""
    draws = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)) if n else []
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def scattered(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """All rows as (h, row), and (h, size) of all rows, written.  ``h`` hardly ever repeats."""
    text = F.col(text_col).cast("string")
    h = F.xxhash64(F.lit(seed), F.col(id_col), text)
    rows = docs.select(h.alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    narrow = materialise(docs.select(h.alias("h"), record_size(text).alias("size")), "sizes")
    twins = materialise(narrow.groupBy("h").count().where("count > 1").select("h"), "twins")
    if not twins.head(1):
        return rows, narrow
    # A written salt stays what it is, whichever task reads it again.
    salted = rows.join(twins, "h", "left_semi").withColumn("h", F.xxhash64("h", F.monotonically_increasing_id()))
    salted = materialise(salted, "salted")
    sizes = salted.select("h", record_size(F.col("row").getField(text_col)).alias("size"))
    return rows.join(twins, "h", "left_anti").unionByName(salted), narrow.join(twins, "h", "left_anti").unionByName(sizes)


def write_shards(docs: DataFrame, shards: int = 40, seed: int = 2024, bucket_bytes: int = 32 << 20, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table in random order, one folder a shard, and return it read back with ``shard`` and ``slot``.

    ``slot`` is the place in the shard, from 0 without gaps; files of a shard are sorted by it.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    docs = docs.withColumnsRenamed({c: f"{c}_input" for c in docs.columns if c.lower() in ("shard", "slot")})
    rows, narrow = scattered(docs, id_col, text_col, seed)
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(partitions(spark), -(-total // bucket_bytes))
    bucket = F.pmod("h", F.lit(buckets)).cast("long")

    # One row per bucket, that is per ``bucket_bytes`` of the table: its rows, and the rows of those before it.
    counts = materialise(narrow.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "buckets")
    starts, at = [], 0
    for b, k in sorted(counts.collect()):
        starts.append((b, at))
        at += k
    starts = spark.createDataFrame(starts, "_b long, start long")

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 1):
            mixed = g.take(pa.array(exchange_order(g.num_rows, seed, g.column("bucket")[0].as_py())))
            place = pa.array(np.arange(g.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([mixed.column("bucket"), place, mixed.column("row")], names=["bucket", "place", "row"])

    dealt = rows.select(bucket.alias("bucket"), "h", "row").repartitionById(buckets, F.col("bucket").cast("int"))
    dealt = dealt.sortWithinPartitions("bucket", "h").drop("h")
    mixed = dealt.mapInArrow(exchange, f"bucket long, place long, row {rows.schema['row'].dataType.simpleString()}")
    whole = mixed.join(starts, mixed.bucket == starts._b)
    position = F.col("start") + F.col("place")
    shard = quotient(position * F.lit(shards), max(1, n))
    out = whole.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], shard.cast("int").alias("shard"), position.alias("_at"))
    first = quotient(F.col("shard") * F.lit(n) + F.lit(shards - 1), shards)  # the place of a shard's first row
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", (F.col("_at") - first).alias("slot"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    return back.select(*out.columns)


def digest(written: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of the rows of written shards."""
    text = F.col(text_col).cast("string")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    return written.select(F.col(id_col).alias("doc_id"), record_size(text).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
