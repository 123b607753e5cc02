"""Similarity look-up in large lexicons (inventory C19).

Two texts with an edit distance of at most t share one of the t + 1 segments of either, at a place that
lies at most t off.  Entries are stored under their segments; a phrase looks up its substrings at the
places where a segment of an entry of each possible length could lie.  What meets is verified by its
edit distance, so nothing above the floor is missed and a phrase meets few entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _whole(x: Column) -> Column:
    """Floor and ceiling of products that should be whole, safe against the last bit."""
    return F.floor(x + F.lit(1e-9)).cast("int")


def _least_length(n: Column, floor: float) -> Column:
    """Length of the shortest text that can be as similar as ``floor`` to one of length n."""
    return F.ceil(n * F.lit(floor) - F.lit(1e-9)).cast("int")


def _segments(n: Column, floor: float) -> Column:
    """Number of segments of an entry of length n: one more than the edits that any partner allows, at most n."""
    return F.least(_whole(_whole(n / F.lit(floor)) * F.lit(1 - floor)) + 1, n).cast("int")


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of ``parts`` nearly equal segments of n characters."""
    start = F.floor(n * i / parts).cast("int")
    return start, (F.floor(n * (i + 1) / parts) - start).cast("int")


def lexicon_lookup(utterances: DataFrame, lexicon: DataFrame, phrase: str = "phrase", floor: float = 0.75) -> DataFrame:
    """Utterances with the best entry of every family and kind that is at least ``floor`` similar.

    Similarity is 1 - edit distance / longer length, of lower-cased text; ties go to the first entry in code-point
    order.  Utterances that resemble nothing, and null or empty phrases and entries, have no row.
    ``floor`` lies above 0.5 and at most at 1.
    """
    if not 0.5 < floor <= 1:
        raise ValueError("floor must lie above 0.5 and at most at 1")
    entries = lexicon.select("family", "kind", F.lower("entry").alias("entry")).where("length(entry) > 0").distinct()
    words = entries.select("entry").distinct().withColumn("_n", F.length("entry"))
    parts = _segments(F.col("_n"), floor)

    def stored(i: Column) -> Column:
        start, size = _segment(F.col("_n"), parts, i)
        return F.struct(i.alias("i"), F.substring(F.col("entry"), start + 1, size).alias("text"))

    index = words.select("entry", "_n", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), stored)).alias("_s")).select("entry", "_n", "_s.*")

    said = utterances.select(F.col(phrase).alias("_said")).distinct().withColumn("_low", F.lower("_said")).where("length(_low) > 0")
    m = F.length("_low")

    def looked(n: Column) -> Column:
        edits = _whole(F.greatest(n, m) * F.lit(1 - floor))
        count = _segments(n, floor)

        def of_segment(i: Column) -> Column:
            start, size = _segment(n, count, i)
            # Where a segment can lie that has at most ``edits`` edits before it and after it.
            first = F.greatest(start - edits, start + (m - n) - edits, F.lit(0))
            last = F.least(start + edits, start + (m - n) + edits, m - size)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(n.alias("n"), i.alias("i"), F.substring(F.col("_low"), at + 1, size).alias("text")))

        return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), of_segment))

    lengths = F.sequence(F.greatest(_least_length(m, floor), F.lit(1)), _whole(m / F.lit(floor)))
    asked = said.select("_said", "_low", F.explode(F.array_distinct(F.flatten(F.transform(lengths, looked)))).alias("_q")).select("_said", "_low", "_q.*")
    met = asked.join(index, (asked.n == index._n) & (asked.i == index.i) & (asked.text == index.text)).select("_said", "_low", "entry").distinct()
    score = 1 - F.levenshtein("_low", "entry") / F.greatest(F.length("_low"), F.length("entry"))
    met = met.withColumn("score", score).where(F.col("score") >= floor)
    best = met.join(entries, "entry").groupBy("_said", "family", "kind").agg(F.min(F.struct((-F.col("score")).alias("less"), "entry")).alias("_b"))
    best = best.select("_said", "family", "kind", F.col("_b.entry").alias("entry"), (-F.col("_b.less")).alias("score"))
    return utterances.join(best, utterances[phrase] == best["_said"]).drop("_said")
