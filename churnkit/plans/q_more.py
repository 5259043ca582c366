"""Registered queries: two-stage batch prediction, feature lists, v2 describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import preprocess_all
from ..functions.core import round_doubles
from ..operators import explain as X
from ..operators.inference import two_stage_decision
from ..operators.profiling import describe_basic
from ..operators.tables_v1 import build_purchase_features, build_transaction_features
from ..operators.tables_v2 import build_generation_features_v2
from ..session import configure
from ..sources.fixtures import FIXTURE_OBS_DATE, load_logical

V2_COLS = ["max_gap_days_last_30", "zero_gen_days_last_30", "days_since_last_completed_gen",
           "completion_rate_last14", "plan_renewal_proximity_days", "gens_last7_pct_of_avg", "trailing_silence_days"]


def q_predict_two_stage(spark, sf_dir):
    """I1 + I2: rule gate, then stage-1 cut at .30 and stage-2 cut at .5.  Stage
    probabilities come from the additive contributions (softmax of margins)."""
    configure(spark)
    raw = load_logical(spark, sf_dir)
    t = preprocess_all(raw)
    txn = build_transaction_features(t["transactions"], t["purchases"], FIXTURE_OBS_DATE).select(
        "user_id", "has_failed_but_no_successful_payment", "n_failed_transactions")
    pur = build_purchase_features(t["purchases"], FIXTURE_OBS_DATE).select("user_id", "n_purchases_total")
    p = X.margins_to_proba(raw["contributions"])
    p = p.select("user_id", (F.col("p1") + F.col("p2")).alias("p_churn"),
                 F.try_divide(F.col("p2"), F.col("p1") + F.col("p2")).alias("p_invol"))
    x = (t["users"].select("user_id").join(txn, "user_id", "left").join(pur, "user_id", "left")
         .join(p, "user_id", "left"))
    x = x.withColumn("is_likely_free_tier_user",
                     ((F.coalesce("n_purchases_total", F.lit(0)) == 0)
                      & (F.coalesce("n_failed_transactions", F.lit(0)) == 0)).cast("long"))
    out = two_stage_decision(x, "p_churn", "p_invol", 0.30)
    return round_doubles(out.select("user_id", "final_label", "p_churn", "p_invol", "predicted_status"))


def q_feature_lists(spark, sf_dir):
    configure(spark)
    return X.feature_lists(load_logical(spark, sf_dir)["contributions"])


def q_describe_v2(spark, sf_dir):
    configure(spark)
    t = preprocess_all(load_logical(spark, sf_dir))
    v2 = build_generation_features_v2(t["generations"], t["properties"], FIXTURE_OBS_DATE)
    return round_doubles(describe_basic(v2, V2_COLS))


def q_evaluate_predictions(spark, sf_dir):
    """I4: the two-stage predictions joined to the labels by user, per-class report."""
    from ..plans.models import evaluate_predictions
    pred = q_predict_two_stage(spark, sf_dir)
    u = load_logical(spark, sf_dir)["users"]
    y = F.element_at(F.create_map(F.lit("not_churned"), F.lit(0), F.lit("vol_churn"), F.lit(1),
                                  F.lit("invol_churn"), F.lit(2)), F.col("churn_status")).cast("int")
    return round_doubles(evaluate_predictions(pred, u.select("user_id", y.alias("y"))))


QUERIES = {
    "evaluate_predictions": q_evaluate_predictions,
    "predict_two_stage": q_predict_two_stage,
    "feature_lists": q_feature_lists,
    "describe_v2_features": q_describe_v2,
}
