"""Inference (I1-I4): rule gate, two-stage decision, 3-class scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg


def apply_gate(df: DataFrame) -> DataFrame:
    """Free-tier users -> not_churned; failed-and-never-paid (not free tier)
    -> invol_churn; everyone else NULL (left to the models)."""
    have = set(df.columns)
    lab = F.lit(None).cast("string")
    free = F.col("is_likely_free_tier_user") == 1 if "is_likely_free_tier_user" in have else F.lit(False)
    if "is_likely_free_tier_user" in have:
        lab = F.when(free, F.lit("not_churned")).otherwise(lab)
    if "has_failed_but_no_successful_payment" in have:
        not_free = (F.coalesce(F.col("is_likely_free_tier_user"), F.lit(None)) == 0
                    if "is_likely_free_tier_user" in have else F.lit(True))
        lab = F.when((F.col("has_failed_but_no_successful_payment") == 1) & not_free,
                     F.lit("invol_churn")).otherwise(lab)
    return df.withColumn("final_label", lab)


def two_stage_decision(df: DataFrame, p_s1: str, p_s2: str, threshold_s1: float = 0.30) -> DataFrame:
    """Gate first; below the stage-1 threshold -> not_churned; else stage 2 at .5."""
    d = apply_gate(df) if "final_label" not in df.columns else df
    model = F.when(F.col(p_s1) < threshold_s1, F.lit("not_churned")).when(
        F.col(p_s1) >= threshold_s1, F.when(F.col(p_s2) >= 0.5, "invol_churn").otherwise("vol_churn"))
    return d.withColumn("predicted_status", F.coalesce(F.col("final_label"), model))


def label_from_argmax(pred: str = "pred") -> F.Column:
    """Class index -> name."""
    m = F.create_map(*[x for i, n in enumerate(cfg.CLASS_NAMES) for x in (F.lit(i), F.lit(n))])
    return F.element_at(m, F.col(pred))
