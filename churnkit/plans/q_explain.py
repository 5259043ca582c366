"""Registered explanation / strategy queries over the ``contributions`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_doubles
from ..operators import explain as X
from ..operators.metrics import argmax3
from ..session import configure
from ..sources.fixtures import load_logical


def _load(spark, sf_dir):
    configure(spark)
    t = load_logical(spark, sf_dir, spread=True)
    y = F.element_at(F.create_map(F.lit("not_churned"), F.lit(0), F.lit("vol_churn"), F.lit(1),
                                  F.lit("invol_churn"), F.lit(2)), F.col("churn_status"))
    users = t["users"].select("user_id", y.cast("int").alias("y"))
    return t["contributions"], users


def _proba(contrib, users):
    return X.margins_to_proba(contrib).join(users, "user_id")


def q_global_importance(spark, sf_dir):
    c, _ = _load(spark, sf_dir)
    return round_doubles(X.global_importance(c))


def q_top_reasons(spark, sf_dir):
    c, _ = _load(spark, sf_dir)
    return round_doubles(X.top_reasons(c, 5))


def q_interventions(spark, sf_dir):
    c, _ = _load(spark, sf_dir)
    return X.map_to_intervention(X.top_reasons(c, 5), spark).drop("action")


def q_explain_examples(spark, sf_dir):
    """Example users -> predicted class -> top-5 reasons -> intervention."""
    c, u = _load(spark, sf_dir)
    p = _proba(c, u)
    ex = X.select_example_users(p).withColumn("pred_class", argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
    reasons = X.top_reasons(c.join(ex.select("user_id", F.col("pred_class").alias("class")), ["user_id", "class"]), 5)
    iv = X.map_to_intervention(ex.select("user_id", F.col("pred_class").alias("class"), F.lit("").alias("feature"))
                               .unionByName(reasons.select("user_id", "class", "feature")), spark)
    out = (ex.select("user_id", F.col("y").alias("true_class"), "example_rank", "pred_class", "p0", "p1", "p2")
             .join(reasons.withColumnRenamed("class", "pred_class"), ["user_id", "pred_class"], "left")
             .join(iv.select("user_id", F.col("class").alias("pred_class"), F.col("label").alias("intervention")),
                   ["user_id", "pred_class"], "left"))
    return round_doubles(out)


def q_strategy_summary(spark, sf_dir):
    c, _ = _load(spark, sf_dir)
    return X.strategy_summary(c, spark, 10).select(
        "class", "cluster", "label", F.array_join("matched_features", ",").alias("matched_features"))


def q_risk_histogram(spark, sf_dir):
    c, u = _load(spark, sf_dir)
    return X.risk_histogram(_proba(c, u))


QUERIES = {
    "global_importance": q_global_importance,
    "top_reasons": q_top_reasons,
    "intervention_mapping": q_interventions,
    "explain_examples": q_explain_examples,
    "strategy_summary": q_strategy_summary,
    "risk_histogram": q_risk_histogram,
}
