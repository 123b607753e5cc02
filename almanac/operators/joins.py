"""Entity resolution, alignment, range joins and integrity checks (inventory C)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.scalars import alias_values, slug
from .patterns import global_index, join_same, only_row, previous_value


def resolve_entities(
    lists: Sequence[DataFrame], codes1: DataFrame, codes2: DataFrame, alias: Mapping[str, str], unicode: bool = True
) -> DataFrame:
    """Names of several lists to codes.

    Aliases are applied to the slug *before* the two code tables (slug, code) are joined; the
    second table fills what the first lacks; unresolved names are dropped; one row per code, the
    alphabetically first name wins.
    """
    names = reduce(DataFrame.union, [x.select("name") for x in lists]).where("name IS NOT NULL").distinct()
    keyed = names.withColumn("slug", alias_values(slug("name", unicode), alias))
    c1 = codes1.select("slug", F.col("code").alias("_c1")).dropDuplicates(["slug"])
    c2 = codes2.select("slug", F.col("code").alias("_c2")).dropDuplicates(["slug"])
    coded = keyed.join(c1, "slug", "left").join(c2, "slug", "left").withColumn("code", F.coalesce("_c1", "_c2"))
    return coded.where("code IS NOT NULL").groupBy("code").agg(F.min(F.struct("name", "slug")).alias("_n")).select(
        "code", "_n.name", "_n.slug"
    )


def map_code(df: DataFrame, codes: DataFrame, src: str, dst: str) -> DataFrame:
    """Replace a code by another one, dropping rows the map does not know."""
    return df.join(codes.select(src, dst), src).drop(src)


def common_entities(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in every source."""
    sets = [d.select(key).distinct() for d in dfs]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), sets)


def replicate_annual(annual: DataFrame, panel: DataFrame, by: Sequence[str], month="month", year="year", lag_years=1) -> DataFrame:
    """Every month of year y takes the annual values of year y - lag (never a later one)."""
    a = annual.withColumn("_y", F.col(year) + lag_years).drop(year)
    return panel.withColumn("_y", F.year(month)).join(a, [*by, "_y"], "left").drop("_y")


def hconcat(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several panels side by side on their keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), dfs)


def attach_labels(samples: DataFrame, labels: DataFrame, entity: str = "entity", t_end: str = "t_end", t: str = "t") -> DataFrame:
    """Labels looked up at the window end."""
    return samples.join(labels.withColumnRenamed(t, t_end), [entity, t_end])


def subset(df: DataFrame, key: str, keep: DataFrame, extra: Sequence = ()) -> DataFrame:
    """Rows of the listed entities (a table of keys, plus an inline list)."""
    by_table = F.col(key).isin(list(extra)) if extra else F.lit(False)
    marked = df.join(keep.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return marked.where(F.col("_in") | by_table).drop("_in") if extra else df.join(keep, key, "left_semi")


def reindex_entities(entities: DataFrame, old: str, segment_on: str | None = None) -> DataFrame:
    """Dense new ordinals in ascending order of the old one; both are kept."""
    return global_index(
        entities.withColumn("_k", F.col(segment_on or old).cast("double")), "_k", [old], "new_ord"
    ).drop("_k").withColumn("new_ord", F.col("new_ord").cast("int"))


# Three-letter codes of the African countries.
AFRICA_ISO3 = [
    "DZA", "AGO", "BEN", "BWA", "BFA", "BDI", "CMR", "CPV", "CAF", "TCD", "COM", "COD", "COG", "CIV", "DJI", "EGY", "GNQ", "ERI",
    "SWZ", "ETH", "GAB", "GMB", "GHA", "GIN", "GNB", "KEN", "LSO", "LBR", "LBY", "MDG", "MWI", "MLI", "MRT", "MUS", "MAR", "MOZ",
    "NAM", "NER", "NGA", "RWA", "STP", "SEN", "SYC", "SLE", "SOM", "ZAF", "SSD", "SDN", "TZA", "TGO", "TUN", "UGA", "ZMB", "ZWE",
]


def in_continent(code: Column | str, continent: str, dim: DataFrame | None = None, df: DataFrame | None = None):
    """Membership by dimension table (``df`` semi-joined) or, without one, by the fixed African set."""
    if dim is not None and df is not None:
        return df.join(dim.where(F.col("continent") == continent).select(code), code, "left_semi")
    c = F.col(code) if isinstance(code, str) else code
    return c.isin(AFRICA_ISO3) if continent == "AF" else F.lit(False)


def availability(catalog: DataFrame, months: DataFrame, codes: Sequence[str], policy: str = "nan") -> DataFrame:
    """C11: expected month x code against the catalog.

    ``error`` raises if anything is missing, ``skip`` drops months with a gap, ``nan`` keeps all
    rows with ``present = 0``.
    """
    want = months.select("month").distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    have = catalog.select("month", "code").distinct().withColumn("present", F.lit(1))
    out = want.join(have, ["month", "code"], "left").na.fill(0, ["present"])
    if policy == "error":
        missing = out.where("present = 0").limit(5).collect()
        if missing:
            raise ValueError(f"missing inputs, for example {missing}")
    if policy == "skip":
        whole = F.min("present").over(Window.partitionBy("month"))
        out = out.withColumn("_w", whole).where("_w = 1").drop("_w")
    return out


# --- ordered joins ---------------------------------------------------------------------------


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, tie: str, tol: float | None = None, prefix: str = "r_"
) -> DataFrame:
    """C14: for each left row the latest right row of the same key at or before it.

    ``on`` is numeric (for instance microseconds) and named alike on both sides; ``tie`` orders
    equal positions.  Both sides are merged into one ordered stream and cut into segments, so a
    key with a third of all rows is spread over many tasks.
    """
    extra = [c for c in right.columns if c not in (*by, on)]
    lhs = left.select(*by, F.col(on).cast("double").alias("_x"), F.lit(1).alias("_side"), F.col(tie).cast("bigint").alias("_tie"),
                      F.struct(*left.columns).alias("_l"))
    rhs = right.select(*by, F.col(on).cast("double").alias("_x"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"),
                       F.struct(F.col(on), *extra).alias("_r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    res = previous_value(both, by, "_x", ["_x", "_side", "_tie"], "_r", "_hit", inclusive=True).where("_side = 1")
    hit = F.col("_hit") if tol is None else F.when(F.col("_l")[on] - F.col("_hit")[on] <= tol, F.col("_hit"))
    res = res.withColumn("_hit", hit)
    return res.select("_l.*", *[F.col("_hit")[c].alias(f"{prefix}{c}") for c in (on, *extra)])


def nearest_join(obs: DataFrame, assets: DataFrame, on: str, key: str, asset_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Nearest asset along a one-dimensional position (ties up to 1e-9: the lower position, then key).

    The nearest one is the closest below or the closest above, each found by a segmented
    look-back, so no distance limit and no pairing of all rows is needed.
    """
    asset = F.struct(F.col(on).cast("double").alias("pos"), F.col(asset_key).alias("key"))
    o = obs.select(*by, F.col(on).cast("double").alias("_x"), F.lit(1).alias("_side"), F.col(key).alias("_id"), F.struct(*obs.columns).alias("_l"))
    a = assets.groupBy(*by, on).agg(F.min(asset_key).alias(asset_key)).select(
        *by, F.col(on).cast("double").alias("_x"), F.lit(0).alias("_side"), asset.alias("_a"))
    both = o.unionByName(a, allowMissingColumns=True).withColumn("_neg", -F.col("_x"))
    down = previous_value(both, by, "_x", ["_x", "_side", "_id"], "_a", "_below", inclusive=True)
    up = previous_value(down, by, "_neg", ["_neg", "_side", "_id"], "_a", "_above", inclusive=True).where("_side = 1")
    d0, d1 = F.col("_x") - F.col("_below.pos"), F.col("_above.pos") - F.col("_x")
    pick = F.when(d1.isNull() | (d0 - d1 <= 1e-9), F.col("_below")).otherwise(F.col("_above"))
    return up.withColumn("_n", pick).select("_l.*", F.col("_n.key").alias("nearest"), F.abs(F.col("_x") - F.col("_n.pos")).alias("distance"))


def interval_join(
    obs: DataFrame, intervals: DataFrame, day: str, mile: str, start: str, end: str, lo: str, hi: str, width: float = 10.0
) -> DataFrame:
    """Observations inside an interval's days and miles.

    Intervals are expanded to the (day, mile bucket) cells they cover; the equi-join on the cell
    is followed by the exact range test, and every pair meets in exactly one cell.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    iv = intervals.withColumn(day, F.explode(F.sequence(F.col(start), F.col(end)))).withColumn(
        "_b", F.explode(F.sequence(cell(lo), cell(hi)))
    )
    j = obs.withColumn("_b", cell(mile)).join(iv, [day, "_b"])
    return j.where((F.col(mile) >= F.col(lo)) & (F.col(mile) <= F.col(hi))).drop("_b")


def align(df: DataFrame, by: Sequence[str], ts: str, freq: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregate to a coarser calendar (``DAY``, ``WEEK``, ``MONTH``) named ``period``."""
    return df.groupBy(*by, F.date_trunc(freq, F.col(ts)).cast("date").alias("period")).agg(*[c.alias(k) for k, c in aggs.items()])


def validate_codes(facts: DataFrame, reference: DataFrame, key: str, scheme: str | None = None) -> DataFrame:
    """C17: codes used in the facts that the reference (of the same scheme) does not know, with their row counts."""
    keys = [key] + ([scheme] if scheme else [])
    used = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(reference.select(*keys).distinct(), keys, "left_anti")


def benchmark_to_total(micro: DataFrame, totals: DataFrame, by: Sequence[str], value: str, total: str) -> DataFrame:
    """Scale micro values so that each group adds up to the published total."""
    sums = micro.groupBy(*by).agg(F.sum(value).alias("_s"))
    ratio = join_same(sums, totals.select(*by, total), by).select(*by, F.try_divide(F.col(total), F.col("_s")).alias("ratio"))
    return join_same(micro, ratio, by).withColumn("scaled", F.col(value) * F.col("ratio"))


# --- lexicon -----------------------------------------------------------------------------------


def lexicon_score(utterances: DataFrame, lexicon: DataFrame, phrase: str = "phrase", floor: float = 0.0) -> DataFrame:
    """Best similarity of each utterance to each device family's active and defensive entries.

    The lexicon is a fixed dimension (family, kind, entry); it enters as one scalar array, and every
    distinct phrase is compared with all of it inside its row.  Similarity is 1 - edit distance / longer
    length; below ``floor`` it counts as 0, so every utterance keeps a row per family and kind, also
    one that resembles nothing.  A null phrase scores 0.
    """
    best = _phrase_scores(utterances, lexicon, phrase, floor)
    return utterances.join(best, utterances[phrase].eqNullSafe(best["_said"]), "left").drop("_said").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexicon_pairs(utterances: DataFrame, lexicon: DataFrame, phrase: str = "phrase", floor: float = 0.0) -> DataFrame:
    """:func:`lexicon_score` with the kinds side by side: per utterance and family ``s_act`` and ``s_def``.

    The kinds meet on the distinct phrases; an utterance is joined to one narrow row per family and never grouped.
    """
    at = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    best = _phrase_scores(utterances, lexicon, phrase, floor).groupBy("_said", "family").agg(at("active").alias("s_act"), at("defensive").alias("s_def"))
    zero = {s: F.coalesce(s, F.lit(0.0)) for s in ("s_act", "s_def")}
    return utterances.join(best, utterances[phrase].eqNullSafe(best["_said"]), "left").drop("_said").withColumns(zero)


def _phrase_scores(utterances: DataFrame, lexicon: DataFrame, phrase: str, floor: float) -> DataFrame:
    lex = lexicon.groupBy("family", "kind").agg(F.collect_set(F.lower("entry")).alias("entries"))
    whole = only_row(lex, F.collect_list(F.struct("family", "kind", "entries")).alias("l"))
    said = utterances.select(F.col(phrase).alias("_said")).distinct().withColumn("_low", F.lower("_said"))
    rows = said.withColumn("_x", F.explode(whole["l"])).select("_said", "_low", "_x.*")
    sim = F.transform("entries", lambda e: 1 - F.levenshtein(F.col("_low"), e) / F.greatest(F.length("_low"), F.length(e)))
    best = rows.withColumn("score", F.coalesce(F.array_max(sim), F.lit(0.0)))
    return best.select("_said", "family", "kind", F.when(F.col("score") >= floor, F.col("score")).otherwise(0.0).alias("score"))


def deploy_lexicon(lexicon: DataFrame, inventory: DataFrame) -> DataFrame:
    """C20: per device its active entries and, as defensive ones, the entries of the other families at home."""
    homes = inventory.select("home", "family").distinct()
    own = homes.join(lexicon.select("family", "entry"), "family").withColumn("kind", F.lit("active")).withColumnRenamed("family", "device")
    others = homes.withColumnRenamed("family", "device").join(homes, "home").where("device <> family")
    guard = others.join(lexicon.select("family", "entry"), "family").select("home", "device", "entry", F.lit("defensive").alias("kind"))
    return own.select("home", "device", "entry", "kind").unionByName(guard).distinct()


def pair_predictions(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two models' scores of the same samples."""
    return a.select(*key, "y_true", F.col("y_prob").alias("p_a")).join(b.select(*key, F.col("y_prob").alias("p_b")), list(key))


def resolve_order(n: int | None, key: str, override: DataFrame | None, stored: DataFrame | None, heuristic: DataFrame) -> DataFrame:
    """Entity order from an override, else the stored order, else the sorted keys.

    With ``n`` a given order must have n rows and the heuristic takes the first n keys; without it all
    keys count.
    """
    for cand in (override, stored):
        if cand is not None:
            if n is not None and cand.limit(n + 1).count() != n:
                raise ValueError(f"entity order must have {n} rows")
            return cand.select("ord", key)
    picked = heuristic.select(key).distinct()
    picked = picked if n is None else picked.orderBy(key).limit(n)
    return reindex_entities(picked, key).select(F.col("new_ord").alias("ord"), key)


def integrity_report(samples: DataFrame, panel: DataFrame, entity: str, t: str, t_end: str = "t_end") -> DataFrame:
    """Ordinal range, month count per entity and orphan samples, one row per check."""
    counts = panel.groupBy(entity).agg(F.countDistinct(t).alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    c = counts.agg(F.sum((F.col("_n") != F.col("_hi") - F.col("_lo") + 1).cast("bigint")).alias("v"))
    top = only_row(panel, F.max(t).alias("m"))
    beyond = samples.withColumn("_m", top).agg(F.sum((F.col(t_end) > F.col("_m.m")).cast("bigint")).alias("v"))
    orphans = samples.join(panel.select(entity, F.col(t).alias(t_end)), [entity, t_end], "left_anti").agg(F.count(F.lit(1)).alias("v"))
    name = lambda df, s: df.select(F.lit(s).alias("check"), F.coalesce("v", F.lit(0)).cast("bigint").alias("violations"))
    return name(c, "incomplete_calendar").unionByName(name(beyond, "ordinal_out_of_range")).unionByName(name(orphans, "orphan_samples"))


def assemble_samples(samples: DataFrame, windows: DataFrame, statics: DataFrame, win: str = "win_idx", entity="entity", t_end="t_end") -> DataFrame:
    """Dynamic window by window index, statics by (entity, window end)."""
    return samples.join(windows, win).join(statics, [entity, t_end], "left")
