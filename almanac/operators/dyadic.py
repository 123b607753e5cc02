"""Interval joins by dyadic decomposition (inventory C15, M14).

A run of whole units is a disjoint union of at most 2 log n dyadic blocks [i 2^l, (i + 1) 2^l).  An
interval is stored as its blocks, a point looks at the one block of every level in use, and the two
meet in an equi-join exactly once.  Years of quarter hours cost a few dozen rows, not one row a quarter
hour.  In several dimensions the blocks are multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .patterns import only_row


@dataclass(frozen=True)
class Axis:
    """A column of points, the columns of an interval's first and last point (both included), and the unit they are counted in."""

    point: str
    start: str
    end: str
    unit: float = 1.0


def cell(c: Column, unit: float) -> Column:
    """The unit that a number lies in, from 0 on for any sign."""
    return (F.floor(c.cast("double") / F.lit(float(unit))) + F.lit(1 << 40)).cast("long")


def name(level: Column, block: Column) -> Column:
    """One number for a block: the level in the top bits."""
    return (F.shiftleft(level.cast("long"), 56) + block).cast("long")


def blocks(first: Column, last: Column) -> Column:
    """The dyadic blocks, by :func:`name`, of the units ``first`` to ``last``; none if they are the wrong way round or null.

    At level l the units from ceil(first / 2^l) to floor((last + 1) / 2^l) are whole blocks; an odd end is a
    block that no higher level has.
    """
    end = last + 1

    def level(l: Column) -> Column:  # noqa: E741
        size = F.pow(F.lit(2.0), l).cast("long")
        lo, hi = F.floor((first + size - 1) / size).cast("long"), F.floor(end / size).cast("long")
        odd = lambda v: F.pmod(v, F.lit(2)) == 1
        pick = lambda ok, v: F.when(ok & (lo < hi), name(l, v))
        return F.array_compact(F.array(pick(odd(lo), lo), pick(odd(hi), hi - 1)))

    top = F.ceil(F.log2((last - first + 2).cast("double"))).cast("int")
    empty = F.array().cast("array<bigint>")
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), top), level))).otherwise(empty)


def interval_join(obs: DataFrame, intervals: DataFrame, axes: Sequence[Axis], by: Sequence[str] = ()) -> DataFrame:
    """Every pair of an observation and an interval of the same ``by`` that holds it on all axes, once.

    Dates count in days, other columns are numbers.  Rows with a null point or end meet nothing.  The
    exact comparison follows the equi-join, as a unit may be wider than the ends are sharp.
    """
    number = lambda df, c: F.unix_date(F.col(c)) if df.schema[c].dataType.simpleString() == "date" else F.col(c)
    iv, keys = intervals, []
    for n, a in enumerate(axes):
        iv = iv.withColumn(f"_k{n}", F.explode(blocks(cell(number(intervals, a.start), a.unit), cell(number(intervals, a.end), a.unit))))
        keys.append(f"_k{n}")
    ob = obs
    for n, a in enumerate(axes):
        at = cell(number(obs, a.point), a.unit)
        units = cell(number(intervals, a.end), a.unit) - cell(number(intervals, a.start), a.unit) + 1
        # No block is longer than the longest interval.
        top = only_row(intervals, F.floor(F.log2(F.greatest(F.max(units), F.lit(1)).cast("double"))).cast("int").alias("l"))
        look = F.transform(F.sequence(F.lit(0), F.col("_top.l")), lambda l: name(l, F.floor(at / F.pow(F.lit(2.0), l))))  # noqa: E741, B023
        ob = ob.withColumn("_top", top).withColumn(f"_k{n}", F.explode(F.when(at.isNotNull() & F.col("_top.l").isNotNull(), look))).drop("_top")
    # The planner counts rows before they become blocks and would broadcast what may be a hundred times its estimate.
    j = ob.join(iv.hint("merge"), [*by, *keys])
    for a in axes:
        j = j.where((F.col(a.point) >= F.col(a.start)) & (F.col(a.point) <= F.col(a.end)))
    return j.drop(*keys)
