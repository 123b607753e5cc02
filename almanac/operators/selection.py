"""Exact order statistics by radix selection on the bits of a double (inventory D14, J7).

A finite double maps to a whole number of the same order.  Its leading 16 bits are counted by group in one
scan; the bucket that holds a wanted rank is known from running counts of at most 65,536 buckets, and
only rows of such buckets are counted by their next 12 bits.  Five scans at most give the value itself, and
three where few rows are left by then.  Rows are
never shuffled, sorted or ranked: every scan counts map-side, whatever the number of rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import materialise

#: Bits that each scan looks at, from the top; together they are all 64.
DIGITS = (16, 12, 12, 12, 12)
ONE = 1 << 52
#: Rows that whole values are counted of at once.
FEW = 1 << 20


def with_bits(df: DataFrame, value: Column, out: str) -> DataFrame:
    """``df`` with a long in the order of the finite doubles: sign, exponent and mantissa as they stand in memory.

    Scaling by powers of two is exact, so equal numbers, and only they, get equal longs.  Null for other
    values.  The steps are columns of their own, so that each is computed once.
    """
    two = lambda k: F.pow(F.lit(2.0), k)
    a = F.col("_ob_a")
    normal = a.between(2.0**-1022, 2.0**1023) & (a < 2.0**1023)
    df = df.withColumn("_ob_v", value.cast("double"))
    df = df.withColumn("_ob_a", F.when(F.abs("_ob_v") < float("inf"), F.abs("_ob_v")))
    df = df.withColumn("_ob_e", F.when(normal, F.floor(F.log2(a))))
    df = df.withColumn("_ob_s", a / two(F.col("_ob_e")))  # from 1 to below 2, but for the last bit of the logarithm
    low, high = F.col("_ob_s") < 1, F.col("_ob_s") >= 2
    s = F.when(low, F.col("_ob_s") * 2).when(high, F.col("_ob_s") / 2).otherwise(F.col("_ob_s"))
    e = F.col("_ob_e") + F.when(low, -1).when(high, 1).otherwise(0)
    bits = lambda e, s: (e + 1023) * F.lit(ONE) + ((s - 1) * F.lit(float(ONE))).cast("long")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    large = bits(F.lit(1023).cast("long"), a / F.lit(2.0**1023))
    key = F.when(normal, bits(e, s)).when(a < 2.0**-1022, small).when(a >= 2.0**1023, large)
    return df.withColumn(out, F.when(F.col("_ob_v") < 0, -key).otherwise(key).cast("long")).drop("_ob_v", "_ob_a", "_ob_e", "_ob_s")


def value_ranges(prefixes: Iterable[int], shift: int) -> list[tuple[float, float]]:
    """The doubles whose bits without the last ``shift`` are among ``prefixes``, as ranges (both ends included)."""
    top = (2047 << 52) - 1  # the largest finite number
    number = lambda k: math.copysign(struct.unpack("<d", struct.pack("<q", min(abs(k), top)))[0], k)
    out: list[list[int]] = []
    for p in sorted(prefixes):
        lo, hi = p << shift, ((p + 1) << shift) - 1
        if out and out[-1][1] + 1 == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(number(lo), number(hi)) for lo, hi in out]


def digit(key: Column, level: int) -> Column:
    """The bits of a level: the leading ones with the sign for level 0, its own afterwards."""
    shifted = F.shiftright(key, 64 - sum(DIGITS[: level + 1]))
    return shifted if level == 0 else shifted.bitwiseAND(F.lit((1 << DIGITS[level]) - 1))


def first_counts(rows: DataFrame, by: Sequence[str], value: Column, *more: Column) -> DataFrame:
    """Counts by group and leading digit of the value's bits (null where it has none), with further aggregates of the
    same scan; at most 65,536 rows a group."""
    return with_bits(rows, value, "_key").groupBy(*by, digit(F.col("_key"), 0).alias("d")).agg(F.count(F.lit(1)).alias("n"), *more)


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, ranks: Mapping[tuple, Iterable[int]], counts: DataFrame) -> dict[tuple, dict[int, float]]:
    """Per group (its values of ``by``) the values at 0-based ``ranks``; ``rows`` hold finite doubles.

    ``counts`` (by, d, n) are the counts of the leading digit of the same rows.  Only the wanted ranks, the buckets
    they lie in and their counts come to the driver and go out again: a few numbers per rank.  Once the buckets hold at most
    ``FEW`` rows together, the next scan counts whole values.
    """
    by = list(by)
    spark = rows.sparkSession
    raw = rows.select(*by, F.col(value).alias("_x"))
    schema = StructType([*[StructField(c, rows.schema[c].dataType) for c in by], *[StructField(c, LongType()) for c in ("rank", "prefix", "before")]])
    state = [(*g, int(r), 0, 0) for g, rs in ranks.items() for r in sorted(set(rs))]
    level, last, found = 0, False, {g: {} for g in ranks}
    while state:
        if level == 0:
            hist = counts.select(*by, F.lit(0).cast("long").alias("prefix"), F.col("d").cast("long").alias("d"), "n", F.lit(None).cast("double").alias("x"))
        else:
            shift = 64 - sum(DIGITS[:level])
            # Only rows in the live buckets get bits: ranges of the value, which a stored table's statistics also know.
            live = raw.where(reduce(or_, [F.col("_x").between(lo, hi) for lo, hi in value_ranges({r[-2] for r in state}, shift)]))
            some = with_bits(live, F.col("_x"), "_key").withColumn("prefix", F.shiftright("_key", shift))
            d = F.col("_key") if last else digit(F.col("_key"), level)
            hist = some.groupBy(*by, "prefix", d.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("_x").alias("x"))
        # A bucket's rows are counted up to it among at most 65,536 buckets, or FEW values.
        hist = hist.withColumn("end", F.sum("n").over(Window.partitionBy(*by, "prefix").orderBy("d")))
        h = hist.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("prefix").alias("_p"), "d", "n", "end", "x")
        asked = spark.createDataFrame(state, schema)
        same = [asked[c].eqNullSafe(h[f"_{c}"]) for c in by] + [asked["prefix"] == h["_p"]]
        rest = F.col("rank") - F.col("before")
        hits = h.join(F.broadcast(asked), same).where((rest < F.col("end")) & (rest >= F.col("end") - F.col("n"))).select(*by, "rank", "prefix", "d", (F.col("before") + F.col("end") - F.col("n")).alias("before"), "n", "x").collect()
        done = last or level == len(DIGITS) - 1
        state, held = [], {}
        for hit in hits:
            g = tuple(hit[c] for c in by)
            if done:
                found[g][hit["rank"]] = hit["x"]
                continue
            prefix = hit["d"] if level == 0 else (hit["prefix"] << DIGITS[level]) | hit["d"]
            state.append((*g, hit["rank"], prefix, hit["before"]))
            held[(*g, prefix)] = hit["n"]
        last = sum(held.values()) <= FEW
        level += 1
    return found


def radix_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], counts: DataFrame | None = None) -> DataFrame:
    """(by, q, value, n): linearly interpolated quantiles of the finite values of few groups.

    ``df`` is scanned up to five times: it should be a stored table.  ``counts`` are :func:`first_counts` of it,
    where another scan has made them already.  Groups without a value have no row.
    """
    by = list(by)
    c = F.col(value).cast("double")
    rows = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).select(*by, c.alias("_v"))
    counts = materialise(counts if counts is not None else first_counts(rows, by, F.col("_v")), "digits")
    sizes = {tuple(r[c] for c in by): r["n"] for r in counts.groupBy(*by).agg(F.sum("n").alias("n")).collect() if r["n"]}
    at = {(g, float(q)): float(q) * (n - 1) for g, n in sizes.items() for q in qs}
    ranks = {g: [k for q in qs for k in (math.floor(at[g, float(q)]), math.ceil(at[g, float(q)]))] for g in sizes}
    found = order_statistics(rows, by, "_v", ranks, counts)
    out = []
    for (g, q), p in at.items():
        lo, hi = found[g][math.floor(p)], found[g][math.ceil(p)]
        out.append((*g, q, lo + (hi - lo) * (p - math.floor(p)), sizes[g]))
    schema = [*[StructField(c, df.schema[c].dataType) for c in by], StructField("q", DoubleType()), StructField("value", DoubleType()), StructField("n", LongType())]
    return df.sparkSession.createDataFrame(out, StructType(schema))
