"""Gridded cells as a long table (month, c, y, x, v) (inventory F)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import masks, normalise
from .patterns import only_row, previous_value


def prepare_cells(cells: DataFrame, cap: float, unit_hours: float = 24.0) -> DataFrame:
    """normalised value with land, quiet and active masks as columns of their own."""
    return cells.withColumn("v_norm", normalise("v", "month", cap, unit_hours)).withColumns(masks("v"))


def to_sparse(cells: DataFrame, core: Sequence[str] | None = None) -> DataFrame:
    """positive cells of the core channels."""
    out = cells.where("v > 0")
    return out.where(F.col("c").isin(list(core))) if core else out


def to_dense(sparse: DataFrame, channels: Sequence[str], height: int, width: int) -> DataFrame:
    """every cell of the grid for each month present; absent ones are 0.

    The grid is generated per month, so no table is crossed with another.
    """
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = sparse.select("month").distinct().withColumn("c", F.explode(F.array(*map(F.lit, channels))))
    grid = grid.withColumn("y", seq(height)).withColumn("x", seq(width))
    return grid.join(sparse, ["month", "c", "y", "x"], "left").na.fill(0.0, ["v"])


def any_active(cells: DataFrame) -> DataFrame:
    """is any channel positive at (month, y, x)."""
    return cells.groupBy("month", "y", "x").agg(F.max((F.coalesce("v", F.lit(0.0)) > 0).cast("int")).alias("active"))


#: Rows and columns of a block of cells that one task works on at a time.
BLOCK = 256


def _to_blocks(cells: DataFrame, height: int, width: int, block: int, before: int, after: int) -> DataFrame:
    """(month, c, by, bx, y, x, v): every cell in its block, and in the blocks whose border of ``before`` rows and
    columns above and left, or ``after`` below and right, it lies in.  A cell goes to four blocks at most."""

    def span(pos: Column, n: int) -> Column:
        last = (n - 1) // block
        lo = F.greatest(F.floor((pos - after) / F.lit(block)), F.lit(0)).cast("int")
        hi = F.least(F.floor((pos + before) / F.lit(block)), F.lit(last)).cast("int")
        return F.explode(F.sequence(lo, hi))

    if max(before, after) > block:
        raise ValueError("a border must not be wider than a block")
    inside = cells.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).where("v IS NOT NULL")
    return inside.select("month", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")).withColumn("by", span(F.col("y"), height)).withColumn("bx", span(F.col("x"), width))


def _dense(t: pa.Table, y0: int, x0: int, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block with its border, and which of its cells are there; repeated cells add up."""
    y, x = t.column("y").to_numpy() - y0, t.column("x").to_numpy() - x0
    out, there = np.zeros((rows, cols)), np.zeros((rows, cols), dtype=bool)
    np.add.at(out, (y, x), t.column("v").to_numpy())
    there[y, x] = True
    return out, there


def tile_mean(cells: DataFrame, height: int, width: int, patch: int, channels: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """mean over overlapping patch x patch tiles, stride max(1, patch / 2); absent cells count as 0.

    A block of the grid, with the border its last tiles reach into, becomes a table of sums over all
    rectangles from its corner; a tile is four look-ups in it.  Every month has all tiles of all channels (``channels``,
    else those of the cells): each block of the grid is named once per month and channel, so tiles without a cell are 0.
    """
    p = min(patch, height, width)
    s = max(1, p // 2)
    ny, nx = (height - p) // s + 1, (width - p) // s + 1
    block = max(block, p)
    kind, month = cells.schema["c"].dataType.simpleString(), cells.schema["month"].dataType.simpleString()

    def pool(key: tuple, t: pa.Table) -> pa.Table:
        by, bx = key[2].as_py(), key[3].as_py()
        real = t.filter(pc.is_valid(t.column("v")))
        v, _ = _dense(real, by * block, bx * block, block + p, block + p)
        area = np.zeros((block + p + 1, block + p + 1))
        area[1:, 1:] = v.cumsum(axis=0).cumsum(axis=1)
        # The tiles that begin in this block.
        ty = np.arange(-(-by * block // s), min(ny, -(-(by + 1) * block // s)))
        tx = np.arange(-(-bx * block // s), min(nx, -(-(bx + 1) * block // s)))
        a, b = ty * s - by * block, tx * s - bx * block
        total = area[np.ix_(a + p, b + p)] - area[np.ix_(a, b + p)] - area[np.ix_(a + p, b)] + area[np.ix_(a, b)]
        n = total.size
        cols = [pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(np.repeat(ty, len(tx)).astype(np.int32)), pa.array(np.tile(tx, len(ty)).astype(np.int32)), pa.array(total.ravel() / (p * p))]
        return pa.table(cols, names=["month", "c", "ty", "tx", "tile"])

    listed = F.array(*map(F.lit, channels)) if channels else only_row(cells, F.collect_set("c").alias("c"))["c"]
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block)))
    named = cells.select("month").distinct().withColumn("c", F.explode(listed)).withColumn("by", seq(height)).withColumn("bx", seq(width))
    rows = _to_blocks(cells, height, width, block, 0, p - 1).unionByName(named, allowMissingColumns=True)
    if channels:
        rows = rows.where(F.col("c").isin(list(channels)))
    return rows.groupBy("month", "c", "by", "bx").applyInArrow(pool, f"month {month}, c {kind}, ty int, tx int, tile double")


def tile_vector(tiles: DataFrame) -> DataFrame:
    """one vector per month, ordered by channel and tile; a month has a fixed number of tiles."""
    packed = tiles.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("c", "ty", "tx", "tile"))).alias("_t"))
    return packed.select("month", F.transform("_t", lambda s: s["tile"]).alias("vec"))


def stencil3(cells: DataFrame, height: int, width: int, weights: Mapping[tuple[int, int], float], block: int = BLOCK) -> DataFrame:
    """F8: fixed 3 x 3 smoothing per channel, cells outside the grid count as 0.

    A cell goes to its block, and to the next one where it lies on the border; shifted copies of the block
    are added up.  Rows are the positions that have a cell beside or on them.
    """
    kind, month = cells.schema["c"].dataType.simpleString(), cells.schema["month"].dataType.simpleString()

    def smooth(key: tuple, t: pa.Table) -> pa.Table:
        y0, x0 = key[2].as_py() * block, key[3].as_py() * block
        v, there = _dense(t, y0 - 1, x0 - 1, block + 2, block + 2)
        h, w = min(block, height - y0), min(block, width - x0)
        out, any_ = np.zeros((h, w)), np.zeros((h, w), dtype=bool)
        for (dy, dx), k in weights.items():
            at = (slice(1 + dy, 1 + dy + h), slice(1 + dx, 1 + dx + w))
            out += k * v[at]
            any_ |= there[at]
        y, x = np.nonzero(any_)
        cols = [pa.repeat(key[0], len(y)), pa.repeat(key[1], len(y)), pa.array((y + y0).astype(np.int32)), pa.array((x + x0).astype(np.int32)), pa.array(out[y, x])]
        return pa.table(cols, names=["month", "c", "y", "x", "v"])

    rows = _to_blocks(cells, height, width, block, 1, 1)
    return rows.groupBy("month", "c", "by", "bx").applyInArrow(smooth, f"month {month}, c {kind}, y int, x int, v double")


def active_stats(cells: DataFrame) -> DataFrame:
    """count, mean and population deviation of the positive cells per channel."""
    return cells.where("v > 0").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def ping_density(pings: DataFrame, cell: float, max_gap_hours: float) -> DataFrame:
    """hours per month, class and cell from successive position reports of a vessel.

    ``pings``: vessel, us (microseconds), ping_id, month, cls, x, y.  The time since the previous
    report, capped at ``max_gap_hours``, is credited to the cell of the later report.
    """
    p = pings.withColumn("_x", F.col("us").cast("double"))
    p = previous_value(p, ["vessel"], "_x", ["_x", "ping_id"], "us", "_prev")
    hours = F.least((F.col("us") - F.col("_prev")) / F.lit(3.6e9), F.lit(float(max_gap_hours)))
    grid = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("int")
    return p.where("_prev IS NOT NULL").groupBy("month", "cls", grid("y").alias("cy"), grid("x").alias("cx")).agg(F.sum(hours).alias("hours"))
