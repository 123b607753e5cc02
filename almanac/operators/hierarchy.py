"""Reconciliation of forecasts over a hierarchy of any depth (inventory M5).

Every node of a tree has a forecast of its own with a variance.  The coherent values nearest to them,
in squared deviations weighed by 1 / variance, come from one pass up and one pass down: a node takes in
the sum of its children's estimates and their variances, and afterwards hands its gap down to them in
proportion to the variances.  A level is one aggregation and one join; no matrix is built or solved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def reconcile_tree(nodes: DataFrame, depth: int, node: str = "node", parent: str = "parent", level: str = "level", value: str = "value", var: str = "var") -> DataFrame:
    """``nodes`` with the ``reconciled`` value; levels run from 0 (roots) to ``depth``.

    A null variance is an infinite one: an inner node then is the sum of its children, and a leaf must
    not have it.  A variance of 0 is certain.  A null forecast counts as one with a null variance.
    Parents lie one level above; leaves may lie on any level.
    """
    known = F.col(value).isNotNull() & F.col(var).isNotNull()
    own = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(level).alias("_l"), F.when(known, F.col(value)).alias("_y"), F.when(known, F.col(var)).alias("_v"))
    up = {}
    for at in range(depth, -1, -1):
        here = own.where(F.col("_l") == at)
        if at < depth:
            sums = up[at + 1].groupBy("_p").agg(F.sum("_e").alias("_se"), F.sum("_s").alias("_ss")).withColumnRenamed("_p", "_c")
            j = here.join(sums, here._n == sums._c, "left")
            # The weight of the node's own forecast beside the sum of its children.
            w = F.when(F.col("_v").isNull() | (F.col("_ss") + F.col("_v") == 0), 0.0).otherwise(F.col("_ss") / (F.col("_ss") + F.col("_v")))
            inner = F.col("_ss").isNotNull()
            e = F.when(inner, F.col("_se") + w * (F.coalesce("_y", F.lit(0.0)) - F.col("_se"))).otherwise(F.col("_y"))
            s = F.when(inner, F.when(F.col("_v").isNull(), F.col("_ss")).otherwise(F.col("_v") * w)).otherwise(F.col("_v"))
            here = j.select("_n", "_p", "_l", e.alias("_e"), s.alias("_s"), "_se", "_ss")
        else:
            null = F.lit(None).cast("double")
            here = here.select("_n", "_p", "_l", F.col("_y").alias("_e"), F.col("_v").alias("_s"), null.alias("_se"), null.alias("_ss"))
        up[at] = materialise(here, "level")
    done = up[0].withColumn("_x", F.col("_e"))
    out = done.select("_n", "_x")
    for at in range(1, depth + 1):
        above = done.select(F.col("_n").alias("_c"), F.col("_x").alias("_px"), "_se", "_ss").withColumnsRenamed({"_se": "_pe", "_ss": "_ps"})
        j = up[at].join(above, up[at]._p == above._c, "left")
        share = F.when(F.col("_ps") > 0, F.col("_s") / F.col("_ps")).otherwise(0.0)
        done = materialise(j.select("_n", "_p", "_l", F.coalesce(F.col("_e") + share * (F.col("_px") - F.col("_pe")), F.col("_e")).alias("_x"), "_se", "_ss"), "level")
        out = out.unionByName(done.select("_n", "_x"))
    return nodes.join(out.withColumnRenamed("_x", "reconciled"), nodes[node] == out._n).drop("_n")
