"""Mixing sources to target weights by thresholds on document hashes.

Every document has a hash.  A source's share is the set of documents whose hash lies below a
threshold.  Thresholds come from sums of tokens by (source, hash bucket): the bucket in which the
running sum passes the budget is split into finer buckets, the others are never looked at again.
Nothing is sorted; sets of growing budgets are nested, and a rerun takes the same documents.

Defined results: a null text has size 0; a null source is a source of its own; a null id hashes like
an empty one; rows with the same id are taken together; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, text_of

#: Bits of each level of buckets, and how many levels there are.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def document_hash(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id's text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source with its target.

    ``sizes`` has one row per source (source, source_size).  Sources by code point, null last, get
    ``weights`` in turn; together they share ``share`` of all sizes; a target above ``cap`` times its
    source's size stops there and the excess is shared again.  That ends at min(cap * size, level *
    weight) for one level: the largest level over all prefixes of sources by size per weight.
    The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    below, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", F.max(level).over(whole)) if share < cap else s.withColumn("level", F.lit(float("inf")))
    return s.select("source", "source_size", "place", "weight", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Per row (source, budget) of ``budgets``, the hash below which the source's sizes come nearest the budget.

    ``docs`` has source, h and size; ``h`` has ``bits * levels`` bits.  Level by level the sizes are
    summed by bucket, and only the documents of the bucket that holds the budget go on.  Several
    budgets of a source give nested sets.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("done"))
    # "at" is the hash prefix of the bucket that holds the budget, "done" the sizes before it.
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        state = materialise(state, "cuts")
        sums = docs.withColumn("bucket", F.shiftright("h", shift))
        if level > 1:
            near = state.select("source", "at").distinct()
            sums = sums.alias("d").join(near.alias("n"), F.col("d.source").eqNullSafe(F.col("n.source")) & (F.shiftright("d.bucket", bits) == F.col("n.at")), "left_semi")
        sums = sums.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        state = state.select("source", "budget", "at", "done")
        keyed = sums.select(F.col("source").alias("_s"), "bucket", "words", F.shiftright("bucket", bits).alias("_up"))
        cum = F.sum("words").over(Window.partitionBy("source", "budget").orderBy("bucket"))
        steps = state.join(keyed, state.source.eqNullSafe(keyed._s) & (state["at"] == keyed._up)).withColumn("end", F.col("done") + cum)
        # The first bucket whose end reaches the budget.
        hit = steps.where(F.col("end") >= F.col("budget")).groupBy("source", "budget").agg(F.min(F.struct("bucket", "end", "words")).alias("x"))
        state = hit.select("source", "budget", F.col("x.bucket").alias("at"), (F.col("x.end") - F.col("x.words")).alias("done"), F.col("x.words").alias("words"))
    take = (F.col("done") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("done"))
    return state.select("source", "budget", (F.col("at") + take.cast("long")).alias("below"))


def plan_mix(narrow: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (_s) its size and target, whole copies of every document, and the hash below which one more is taken.

    ``narrow`` has source, h and size per document.  The plan is written, so that its size is known: it
    is broadcast only where it is small enough for the session.
    """
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan, "targets")
    cuts = thresholds(narrow, plan.where("budget > 0"))
    cuts = cuts.select(F.col("source").alias("_s"), "below")
    plan = plan.join(cuts, plan.source.eqNullSafe(cuts._s), "left").drop("_s")
    return materialise(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "below"), "plan")


def narrow_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, h, size), written: texts are read once."""
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), document_hash(F.col(id_col)).alias("h"), word_count(text_of(text_col)).alias("size")), "sizes")


def copies(h: Column) -> Column:
    """How often the plan takes a document: whole copies, and one more below the threshold."""
    return F.col("whole") + F.coalesce(h < F.col("below"), F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it.

    A source whose target is r times its size gives floor(r) copies of every document and one copy
    more of those below the threshold for the rest.  Returns doc_id, source, size, source_size,
    target, copies, taken.
    """
    narrow = narrow_rows(docs, id_col, text_col, source_col)
    plan = plan_mix(narrow, **options)
    out = narrow.join(plan, narrow.source.eqNullSafe(plan._s)).withColumn("copies", copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the input, each as often as the mix takes it."""
    plan = plan_mix(narrow_rows(docs, id_col, text_col, source_col), **options)
    out = docs.join(plan, docs[source_col].cast("string").eqNullSafe(plan._s))
    out = out.select(*[docs[c] for c in docs.columns], copies(document_hash(docs[id_col])).alias("_copies"))
    return out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(lim, (SELECT max(lv) FROM l) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
cells AS (SELECT source, h, sum(size) AS words FROM d GROUP BY 1, 2),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS fin FROM cells),
edge AS (SELECT b.source, min(struct_pack(h := h, fin := fin, words := words)) AS x FROM b JOIN run r ON r.source IS NOT DISTINCT FROM b.source
         WHERE budget > 0 AND fin >= budget GROUP BY 1),
cut AS (SELECT b.*, x.h + CAST(x.fin - budget < budget - (x.fin - x.words) AS BIGINT) AS below FROM b LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST((whole + CAST(coalesce(h < below, false) AS BIGINT)) * size AS BIGINT) AS taken
FROM d JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
"""
