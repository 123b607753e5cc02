"""Report tables and figure data (inventory K), all made of the metric operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import metrics as mt, reshape as rs, splits as sp, surge

prevalence = surge.label_stats  # K1, by horizon


def main_table(preds: DataFrame, by: Sequence[str], budget: float = 0.1) -> DataFrame:
    """K2/K3: discrimination, calibration and alert quality per group."""
    m = mt.metric_table(preds, by)
    return m.join(mt.budget_metrics(preds, by, budget), list(by))


def operational_table(main: DataFrame, by: Sequence[str]) -> DataFrame:
    """K5: the alert columns of the main table."""
    return main.select(*by, "n", "pos", "thr", "hit", "fa_per_100")


def ablation(preds: DataFrame, config: Sequence[str]) -> DataFrame:
    """K6: metrics per configuration."""
    return mt.metric_table(preds, config)


def split_inventory(samples: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """K8."""
    return sp.split_summary(samples, horizons)


FIGURES = {
    "monthly_series": lambda p: mt.metric_table(p, ["month", "horizon"]),
    "top_entities": lambda p: rs.top_by(mt.metric_table(p, ["entity"]), "auprc", 15, "entity"),
    "support_scatter": lambda p: mt.metric_table(p, ["entity"]).select("entity", "n", "pos", "auroc", "auprc"),
    "gap_bars": lambda p: mt.gen_gap(mt.metric_table(p, ["split", "horizon"]), ["horizon"], ["auroc", "auprc"]),
    "roc": lambda p: mt.roc_curve(p, ["horizon"]),
    "pr": lambda p: mt.pr_curve(p, ["horizon"]),
    "reliability": lambda p: mt.reliability(p, ["horizon"]),
    "budget_curves": lambda p: mt.budget_curve(p, ["horizon"], (0.01, 0.05, 0.1, 0.2)),
    "span_effect": lambda p: span_effect(p),
    "support_trend": lambda p: mt.support_curve(mt.metric_table(p, ["entity", "horizon"]), ["horizon"]),
}


def span_effect(preds: DataFrame) -> DataFrame:
    """Metric of each year against the number of years observed before it."""
    m = mt.metric_table(preds, ["year"])
    first = preds.agg(F.struct(F.min("year").alias("y")).alias("f")).scalar()
    return m.withColumn("_f", first).select((F.col("year") - F.col("_f.y")).cast("int").alias("span"), "year", "auroc", "auprc")


def figure_data(name: str, preds: DataFrame) -> DataFrame:
    """K7: the table behind a figure."""
    return FIGURES[name](preds)
