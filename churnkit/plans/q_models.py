"""Registered model queries (rows-only checks: fitted models have no SQL oracle).

Input: a per-user table of subscription, payment (v1) and v2 generation
features built from the driver tables, the 3-class label and stratified
folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import preprocess_all
from ..functions.core import round_doubles
from ..operators.generations import build_generation_features
from ..operators.sampling import assign_folds
from ..operators.tables_v1 import build_properties_features, build_transaction_features
from ..operators.tables_v2 import build_generation_features_v2
from ..session import configure, cut_lineage
from ..sources.fixtures import FIXTURE_OBS_DATE, load_logical
from . import models as MD

FEATURES = ["tenure_days", "n_total_transaction_attempts", "transaction_failure_rate", "cvc_fail_rate",
            "pct_prepaid_transactions", "max_gap_days_last_30", "zero_gen_days_last_30", "trailing_silence_days",
            "gens_last7_pct_of_avg", "completion_rate", "total_generations", "days_since_last_generation"]


def model_input(spark, sf_dir, k: int = 3):
    configure(spark)
    t = preprocess_all(load_logical(spark, sf_dir))
    y = F.element_at(F.create_map(F.lit("not_churned"), F.lit(0), F.lit("vol_churn"), F.lit(1),
                                  F.lit("invol_churn"), F.lit(2)), F.col("churn_status")).cast("int")
    users = t["users"].select("user_id", y.alias("y"))
    g1 = build_generation_features(t["generations"], t["properties"], FIXTURE_OBS_DATE).select(
        "user_id", "completion_rate", "total_generations", "days_since_last_generation")
    x = (users.join(build_properties_features(t["properties"], FIXTURE_OBS_DATE).select("user_id", "tenure_days"),
                    "user_id", "left")
         .join(build_transaction_features(t["transactions"], t["purchases"], FIXTURE_OBS_DATE), "user_id", "left")
         .join(build_generation_features_v2(t["generations"], t["properties"], FIXTURE_OBS_DATE), "user_id", "left")
         .join(g1, "user_id", "left"))
    x = x.select("user_id", "y", *FEATURES)
    return cut_lineage(assign_folds(x, k=k))


def q_two_stage(spark, sf_dir):
    d = model_input(spark, sf_dir)
    return round_doubles(MD.two_stage_cv(d, FEATURES, k=3, params1={"maxIter": 10}, params2={"maxIter": 10}))


def q_multiclass_rf(spark, sf_dir):
    d = model_input(spark, sf_dir)
    return round_doubles(MD.multiclass_cv(d, FEATURES, "rf", k=3, params={"numTrees": 20}))


def q_ovr(spark, sf_dir):
    d = model_input(spark, sf_dir)
    return round_doubles(MD.ovr_specialists(d, FEATURES, k=3, params={"maxIter": 10}))


def q_stack(spark, sf_dir):
    d = model_input(spark, sf_dir)
    l1 = [MD.multiclass_cv(d, FEATURES, "rf", 3, {"numTrees": 20}),
          MD.multiclass_cv(d, FEATURES, "lr", 3, {"family": "multinomial"}, scale=True)]
    return round_doubles(MD.stack(l1, ["rf", "lr"], 3))


def q_search(spark, sf_dir):
    d = model_input(spark, sf_dir)
    return MD.random_search(d, FEATURES, {"numTrees": [10, 20], "maxDepth": [3, 5]}, n_trials=2, k=3)


def q_contrib(spark, sf_dir):
    d = model_input(spark, sf_dir)
    m = MD.final_fit(d, FEATURES, "lr", {"family": "multinomial", "elasticNetParam": 0.0})
    return round_doubles(MD.linear_contributions(m, d, FEATURES))


#: recipes of the registered leaderboard: one or two of each kind
LEADERBOARD = ["A", "C", "N", "K", "L", "P03", "P04", "P08"]


def q_leaderboard(spark, sf_dir):
    """Recipes with their samplers, blends, thresholds and dependencies, one row each."""
    d = model_input(spark, sf_dir)
    recipes = [r for r in MD.CATALOGUE if r.name in LEADERBOARD]
    return round_doubles(MD.run_catalogue(d, FEATURES, recipes, feature_sets={"core": FEATURES[:6]}))


def q_tree_contrib(spark, sf_dir):
    """X1 for trees: Shapley values of a binary GBT (churn vs not), long table."""
    d = model_input(spark, sf_dir).withColumn("y", (F.col("y") > 0).cast("int"))
    m = MD.final_fit(d, FEATURES, "gbt", {"maxIter": 10, "maxDepth": 3})
    return round_doubles(MD.tree_contributions(m, d, FEATURES))


def q_tree_contrib_3class(spark, sf_dir):
    """X1 for trees: Shapley values of a 3-class forest's probabilities, long table."""
    d = model_input(spark, sf_dir)
    m = MD.final_fit(d, FEATURES, "rf", {"numTrees": 10, "maxDepth": 5})
    return round_doubles(MD.tree_contributions(m, d, FEATURES))


def q_ablation(spark, sf_dir):
    """M13 + M9/M10 + M14: imbalance strategies, then feature subsets from the
    correlation and VIF screens."""
    from ..operators.sampling import correlation_filter, vif_filter
    d = model_input(spark, sf_dir)
    imb = MD.imbalance_ablation(d, FEATURES).select(F.concat(F.lit("imbalance:"), "strategy").alias("run"), "macro_f1")
    subsets = {"all": FEATURES, "corr_095": correlation_filter(d, FEATURES), "vif_10": vif_filter(d, FEATURES)}
    fs = MD.feature_subset_ablation(d, subsets).select(F.concat(F.lit("subset:"), "subset").alias("run"), "macro_f1")
    return round_doubles(imb.unionByName(fs))


QUERIES = {
    "ablation_runs": q_ablation,
    "recipe_leaderboard": q_leaderboard,
    "tree_contributions": q_tree_contrib,
    "tree_contributions_3class": q_tree_contrib_3class,
    "two_stage_cv_oof": q_two_stage,
    "multiclass_rf_oof": q_multiclass_rf,
    "ovr_specialists_oof": q_ovr,
    "stacking_oof": q_stack,
    "random_search_leaderboard": q_search,
    "linear_contributions": q_contrib,
}
