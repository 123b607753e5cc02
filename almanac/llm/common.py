"""Registry and helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, new_path, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its SQL twin."""

    def wrap(fn):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    The optimizer writes a column's expression wherever the column is used, also inside lambdas, where
    it would run for every element; a lambda's own variable is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a :func:`sieve`: 4 MB, whatever is marked in it.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, col: str, bits: int = SIEVE_BITS) -> DataFrame:
    """Bitmaps (bucket, bits) with the bit of every 64-bit hash in ``col`` set, written to the shared folder.

    For :func:`sifted`, which tells most rows that an exact join need not see before they are shuffled.
    """
    at = F.pmod(F.col(col), F.lit(bits))
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    return materialise(maps, "sieve")


def sifted(df: DataFrame, col: str, maps: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` with a boolean ``_maybe``: false only where no hash in ``maps`` equals ``col``.

    True may be wrong where hashes share a bit, so an exact join follows for the rows that pass.
    """
    at = F.pmod(F.col(col), F.lit(bits))
    held = df.withColumns({"_at": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}).join(F.broadcast(maps), F.col("_at") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = byte.bitwiseAND(F.pow(F.lit(2.0), F.col("_bit") % 8).cast("long")) > 0
    return held.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_at", "_bit", "_bucket", "_bits")


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of left columns with right columns."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: one row (node, component) per node that has an edge.

    ``component`` is the smallest node that can be reached.  Large-star and small-star steps alternate;
    each step is one aggregation and one join over edges, and its result is written to the shared
    folder, so a lost executor recomputes one step at most.  The number of rounds grows with the
    logarithm of the longest path.  A node with very many neighbours is no hot key: the smallest
    neighbour is a map-side minimum, and the join back to the edges is left to the skew-aware join.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Large star: larger neighbours move to the smallest neighbour (or the node itself).
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        e = materialise(moved.union(own).where("u <> v").distinct(), "edges")
        # Equal edge sets have equal counts and checksums; two numbers reach the driver.
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


#: SQL for the 256 remainders of CRC-32 (reflected polynomial 0xEDB88320), a recursive common table ``crc_table``.
CRC_TABLE = """crc_bits(i, step, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, step + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits WHERE step = 8)"""


def crc_sql(column: str) -> str:
    """SQL for the unsigned CRC-32 of the bytes that ``column`` spells in hex; ``crc_table`` is among the tables."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({column}), 2), lambda p: CAST('0x' || substr({column}, p, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


__all__ = ["CRC_TABLE", "crc_sql", "QUERIES", "ORACLES", "query", "table", "text_of", "lower_ascii", "let", "partitions", "sieve", "sifted", "same", "components", "materialise", "new_path", "ship"]
