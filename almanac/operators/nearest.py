"""Exact nearest neighbours of points in the plane, without the matrix of all pairs (inventory O2-O4, A16).

Points at one place are one *site*.  Sites are cut along x into strips of about equal numbers, about
sqrt(n) of them, and the sites of a strip along y into cells of some hundred, each in the order of x.  Within
its cell a site finds a distance that enough neighbours lie within; then only the cells that this circle
touches are searched, and in them only the stretch of x it covers.  A site whose circle leaves its strip
also visits the strips the circle touches, and the search stops there, as whatever lies beyond is
further than the k-th neighbour.  A strip holds about sqrt(n) sites times a constant, and a site meets a
number of others that does not grow with n.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .patterns import cut_points, with_segment

FOUND = "site long, other long"


#: Candidate pairs that are compared at a time.
AT_ONCE = 1 << 21


class Strip:
    """The sites of a strip, in cells along y that are sorted by x."""

    def __init__(self, site: np.ndarray, x: np.ndarray, y: np.ndarray, cell: int):
        order = np.argsort(y, kind="stable")
        cuts = np.array_split(order, max(1, len(order) // cell)) if len(order) else []
        self.cells = [c[np.argsort(x[c], kind="stable")] for c in cuts]
        self.site, self.x, self.y = site, x, y

    def reach(self, need: int) -> np.ndarray:
        """Per site a distance within which ``need`` sites lie, itself included; infinite in a cell with fewer."""
        r = np.full(len(self.x), np.inf)
        for c in self.cells:
            if len(c) >= need:
                d = np.hypot(self.x[c][:, None] - self.x[c][None, :], self.y[c][:, None] - self.y[c][None, :])
                r[c] = np.partition(d, need - 1, axis=1)[:, need - 1]
        return r

    def inside(self, x0: np.ndarray, y0: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (i, j) of the strip's sites j at most r[i] from (x0[i], y0[i])."""
        out_i, out_j = [np.empty(0, int)], [np.empty(0, int)]
        for c in self.cells:
            cx, cy = self.x[c], self.y[c]
            some = np.nonzero((y0 - r <= cy.max()) & (y0 + r >= cy.min()))[0]
            lo, hi = np.searchsorted(cx, x0[some] - r[some], "left"), np.searchsorted(cx, x0[some] + r[some], "right")
            for part in np.array_split(np.arange(len(some)), int((hi - lo).sum()) // AT_ONCE + 1):
                n = hi[part] - lo[part]
                i = np.repeat(some[part], n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
                near = np.hypot(cx[j] - x0[i], cy[j] - y0[i]) <= r[i]
                out_i.append(i[near])
                out_j.append(c[j[near]])
        return np.concatenate(out_i), np.concatenate(out_j)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _at_home(need: int, slack: float, cell: int):
    """Neighbours within a strip, and the distance that other strips need to be searched to."""

    def run(rows: pa.Table) -> pa.Table:
        strip = Strip(*_columns(rows, "site", "x", "y"), cell)
        r = strip.reach(need) * (1 + 1e-12) + slack
        i, j = strip.inside(strip.x, strip.y, np.where(np.isinf(r), 2.0 * (np.ptp(strip.x) + np.ptp(strip.y)) + 1, r))
        own = pa.table({"site": strip.site, "other": pa.nulls(len(r), pa.int64()), "r": r})
        return pa.concat_tables([own, pa.table({"site": strip.site[i], "other": strip.site[j], "r": pa.nulls(len(i), pa.float64())})])

    return run


def _away(cell: int):
    """Sites of a strip within the circles of guests from other strips."""

    def run(guests: pa.Table, rows: pa.Table) -> pa.Table:
        strip = Strip(*_columns(rows, "site", "x", "y"), cell)
        g, x0, y0, r = _columns(guests, "guest", "x0", "y0", "r")
        i, j = strip.inside(x0, y0, np.where(np.isinf(r), np.finfo(float).max / 4, r))
        return pa.table({"site": g[i], "other": strip.site[j]})

    return run


def nearest(points: DataFrame, coords: Sequence[str], k: int, label: str = "label", tie: str | None = None, digits: int = 10, per_cell: int = 256) -> DataFrame:
    """O3: (node, other, distance, rank) of the k nearest other points of every point.

    Distances are compared after rounding to ``digits``; equal ones go by ``tie`` (default: the label).
    Labels are unique.  Points without coordinates take no part; with fewer than k others all are returned.
    """
    tie = tie or label
    cx, cy = coords
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    p = points.where(number(cx) & number(cy)).select(F.col(label).alias("node"), F.col(tie).alias("tie"), (F.col(cx).cast("double") + 0.0).alias("x"), (F.col(cy).cast("double") + 0.0).alias("y"))
    # Of a place no more than k + 1 points can be among anyone's k nearest; the limit works before the shuffle.
    first = p.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("tie", "node"))).where(F.col("_r") <= k + 1)
    sites = first.groupBy("x", "y").agg(F.collect_list(F.struct("tie", "node")).alias("members"))
    sites = materialise(sites.withColumn("site", F.monotonically_increasing_id()), "sites")

    strips = max(1, round((sites.count() / per_cell) ** 0.5))
    cuts = cut_points(sites, "x", strips) if strips > 1 else []
    narrow = with_segment(sites.select("site", "x", "y"), "x", cuts, "strip")
    home = narrow.groupBy("strip").applyInArrow(_at_home(k + 1, 4 * 10.0**-digits, max(per_cell, 2 * k + 2)), "site long, other long, r double")
    home = materialise(home, "home")
    found = home.where("other IS NOT NULL").select("site", "other")
    if cuts:
        circles = home.where("other IS NULL").select("site", "r").join(narrow, "site")
        circles = with_segment(with_segment(circles.withColumns({"_a": F.col("x") - F.col("r"), "_b": F.col("x") + F.col("r")}), "_a", cuts, "_lo"), "_b", cuts, "_hi")
        visits = circles.where("_lo < strip OR _hi > strip").withColumn("_to", F.explode(F.sequence(F.col("_lo").cast("long"), F.col("_hi").cast("long")))).where("_to <> strip")
        visits = visits.select(F.col("_to").cast("double"), "site", "x", "y", "r").toDF("strip", "guest", "x0", "y0", "r")
        found = found.unionByName(visits.groupBy("strip").cogroup(narrow.groupBy("strip")).applyInArrow(_away(max(per_cell, 2 * k + 2)), FOUND))

    here = sites.select(F.col("site").alias("_s"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    there = sites.select(F.col("site").alias("_o"), "x", "y", "members")
    near = found.join(here, found.site == F.col("_s")).join(there, found.other == F.col("_o"))
    distance = F.round(F.sqrt(F.pow(F.col("x") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y0"), F.lit(2.0))), digits)
    near = near.select("site", "x0", "y0", distance.alias("distance"), F.inline("members"))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy("distance", "tie", "node"))).where(F.col("_r") <= k + 1)
    lists = best.groupBy("site", "x0", "y0").agg(F.array_sort(F.collect_list(F.struct("distance", "tie", "node"))).alias("near"))
    lists = materialise(lists, "lists")
    own = p.join(lists, (p.x == lists.x0) & (p.y == lists.y0))
    others = F.slice(F.filter("near", lambda o: o["node"] != F.col("node")), 1, k)
    out = own.select("node", F.posexplode(others).alias("_i", "o"))
    return out.select("node", F.col("o.node").alias("other"), F.col("o.distance").alias("distance"), (F.col("_i") + 1).alias("rank"))


def closest(points: DataFrame, coords: Sequence[str], k: int, label: str = "label", idx: str = "idx", digits: int = 10) -> DataFrame:
    """The k closest pairs (i_label, j_label, distance), ties by (smaller idx, larger idx).

    Of a pair among the k closest, each point is among the other's k nearest by (distance, idx).
    """
    near = nearest(points, coords, k, label, idx, digits)
    ids = points.select(F.col(label).alias("_l"), F.col(idx).alias("_x"))
    a, b = ids.toDF("node", "i"), ids.toDF("other", "j")
    pairs = near.join(a, "node").join(b, "other")
    flip = F.col("i") > F.col("j")
    pairs = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(flip, F.col("other")).otherwise(F.col("node")).alias("i_label"),
                         F.when(flip, F.col("node")).otherwise(F.col("other")).alias("j_label"), "distance").distinct()
    return pairs.orderBy("distance", "i", "j").limit(k).select("i_label", "j_label", "distance")
