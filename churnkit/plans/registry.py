"""Registered queries: one per operator group of the inventory.

Each entry takes ``(spark, sf_dir)``, builds the logical inputs from the
driver's tables (``sources.fixtures``) and returns a DataFrame whose double
columns are rounded to 6 places (the same projection the SQL oracles use).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import preprocess_all
from ..functions.core import round_doubles
from ..operators.generations import build_generation_features
from ..operators.tables_v1 import (build_properties_features, build_purchase_features,
                                   build_quiz_features, build_transaction_features)
from ..operators.tables_v2 import build_generation_features_v2, build_transaction_features_v2
from ..session import configure
from ..sources.fixtures import FIXTURE_OBS_DATE, load_logical
from . import oracles

OBS = FIXTURE_OBS_DATE


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    configure(spark)
    return preprocess_all(load_logical(spark, sf_dir))


def q_generation_features(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_generation_features(t["generations"], t["properties"], OBS))


def q_subscription_features(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_properties_features(t["properties"], OBS))


def q_purchase_features(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_purchase_features(t["purchases"], OBS)
                         .drop("_first_purchase", "_last_purchase"))


def q_payment_features(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_transaction_features(t["transactions"], t["purchases"], OBS))


def q_quiz_features(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_quiz_features(t["quizzes"]))


def q_payment_features_v2(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_transaction_features_v2(t["transactions"], OBS))


def q_generation_features_v2(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return round_doubles(build_generation_features_v2(t["generations"], t["properties"], OBS))


def q_feature_matrix_v1(spark, sf_dir):
    from .assemble import build_feature_matrix
    return round_doubles(build_feature_matrix(_tables(spark, sf_dir), OBS, version=1))


def q_feature_matrix_v2(spark, sf_dir):
    from .assemble import build_feature_matrix
    return round_doubles(build_feature_matrix(_tables(spark, sf_dir), OBS, version=2))


def q_synthetic_signal(spark, sf_dir):
    from ..operators.cross import add_synthetic_signal
    t = _tables(spark, sf_dir)
    g = build_generation_features(t["generations"], t["properties"], OBS)
    return round_doubles(add_synthetic_signal(g).select(
        "user_id", "engagement_velocity", "credit_cost_decimal", "credit_regularity_score",
        "inter_gen_regularity"))


def flagship(spark, sf_dir):
    """Users at risk: event roll-up + payments + purchases -> rule gate -> leaderboard.

    One row per user, ordered worst first (gate label invol first, then
    longest silence, then failure rate); the order is a range-partitioned
    global sort, not a single-partition window."""
    from ..operators.inference import apply_gate
    t = _tables(spark, sf_dir)
    gen = build_generation_features(t["generations"], t["properties"], OBS).select(
        "user_id", "total_generations", "days_since_last_generation", "failure_rate_overall",
        "engagement_slope")
    txn = build_transaction_features(t["transactions"], t["purchases"], OBS).select(
        "user_id", "has_failed_but_no_successful_payment", "n_failed_transactions", "transaction_failure_rate")
    pur = build_purchase_features(t["purchases"], OBS).select("user_id", "n_purchases_total")
    x = (t["users"].select("user_id").join(gen, "user_id", "left").join(txn, "user_id", "left")
         .join(pur, "user_id", "left"))
    x = x.withColumn("is_likely_free_tier_user",
                     ((F.coalesce("n_purchases_total", F.lit(0)) == 0)
                      & (F.coalesce("n_failed_transactions", F.lit(0)) == 0)).cast("long"))
    x = apply_gate(x)
    x = x.orderBy(F.col("final_label").desc_nulls_last(), F.col("days_since_last_generation").desc_nulls_first(),
                  F.col("transaction_failure_rate").desc_nulls_last(), F.col("user_id"))
    return round_doubles(x)


def q_fe_features(spark, sf_dir):
    """Section 2.12 builder on the raw logical tables (data-derived reference date)."""
    from ..operators.fe_builder import build_fe_features
    from .o_fe import FIXTURE_PIVOTS
    configure(spark)
    t = load_logical(spark, sf_dir)
    return round_doubles(build_fe_features(t, pivots=FIXTURE_PIVOTS))


QUERIES = {
    "at_risk_leaderboard": flagship,
    "fe_features": q_fe_features,
    "subscription_features_v1": q_subscription_features,
    "generation_features_v1": q_generation_features,
    "purchase_features_v1": q_purchase_features,
    "payment_features_v1": q_payment_features,
    "quiz_features_v1": q_quiz_features,
    "payment_features_v2": q_payment_features_v2,
    "generation_features_v2": q_generation_features_v2,
    "feature_matrix_v1": q_feature_matrix_v1,
    "feature_matrix_v2": q_feature_matrix_v2,
    "synthetic_signal_features": q_synthetic_signal,
}

from . import o_artifacts, o_explain, o_metrics, o_profile, q_artifacts, q_explain, q_metrics, q_profile  # noqa: E402,E501
from . import o_sampling, q_ensembles, q_explanations, q_models, q_more, q_sampling  # noqa: E402

QUERIES.update(q_metrics.QUERIES)
QUERIES.update(q_explain.QUERIES)
QUERIES.update(q_artifacts.QUERIES)
QUERIES.update(q_profile.QUERIES)
QUERIES.update(q_sampling.QUERIES)
QUERIES.update(q_models.QUERIES)
QUERIES.update(q_more.QUERIES)
QUERIES.update(q_ensembles.QUERIES)
QUERIES.update(q_explanations.QUERIES)

from . import o_fe  # noqa: E402

ORACLES = {
    "at_risk_leaderboard": oracles.at_risk_leaderboard,
    "fe_features": o_fe.fe_features,
    "subscription_features_v1": oracles.subscription_v1,
    "generation_features_v1": oracles.generations_v1,
    "purchase_features_v1": oracles.purchases_v1,
    "payment_features_v1": oracles.transactions_v1,
    "quiz_features_v1": oracles.quiz_v1,
    "payment_features_v2": oracles.transactions_v2,
    "generation_features_v2": oracles.generations_v2,
    "feature_matrix_v1": oracles.matrix_v1,
    "feature_matrix_v2": oracles.matrix_v2,
    "synthetic_signal_features": oracles.synthetic_signal,
}

ORACLES.update(o_metrics.ORACLES)
ORACLES.update(o_explain.ORACLES)
ORACLES.update(o_artifacts.ORACLES)
ORACLES.update(o_profile.ORACLES)
ORACLES.update(o_sampling.ORACLES)
ORACLES.update(oracles.MORE)
