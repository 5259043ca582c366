"""Per-table roll-ups (v1): subscription (2.5), purchases (2.7), payment
attempts (2.8) and onboarding quiz (2.9).

Each returns one row per user present in its source table (subscription:
property users).  Counts built by filter-then-group are NULL when nothing
matches; shares use ``safe_div``; ordered features (first/last row, plan
changes, retries) use struct min/max aggregates or the chunked
:func:`ordered.ordered`, never a whole-user window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.core import (US_PER_DAY, US_PER_HOUR, cnt, encode_top_n, flag, floor_days,
                              map_lookup, micros, money_avg, money_sum, norm_lower, nullif_zero, safe_div)
from ..functions.clean import dedupe_first, experience_ordinal, frustration_canon, team_size_ordinal
from .generations import obs_ts, tenure_days
from .ordered import ordered


# --------------------------------------------------------------------------- 2.5
def build_properties_features(props: DataFrame, obs_date: str) -> DataFrame:
    start = F.col("subscription_start_date")
    return props.select(
        "user_id", "plan_ordinal", "plan_monthly_credits", "plan_monthly_cost_usd",
        tenure_days(start, obs_date).alias("tenure_days"),
        F.month(start).cast("long").alias("subscription_start_month"),
        F.weekday(start).cast("long").alias("subscription_start_dayofweek"),
        encode_top_n("country_code", cfg.TOP_COUNTRIES).alias("country_encoded"),
    )


# --------------------------------------------------------------------------- 2.7
def build_purchase_features(purchases: DataFrame, obs_date: str, *,
                            chunk_rows: int | None = None) -> DataFrame:
    p = purchases.select("user_id", "transaction_id", "purchase_time", "purchase_type",
                         F.col("purchase_amount_dollars").cast("double").alias("amt"))
    ty = F.col("purchase_type")
    amt = F.col("amt")
    agg = p.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_purchases_total"),
        F.count(ty).alias("_n_typed"),
        cnt(ty == "Subscription Create").alias("_creates"),
        cnt(ty == "Subscription Update").alias("_updates"),
        cnt(ty == "Credits package").alias("_credits"),
        cnt(ty == "Upsell").alias("_upsells"),
        cnt(ty == "Reactivation").alias("_react"),
        money_sum(amt).alias("_sum"), money_avg(amt).alias("avg_purchase_dollars"),
        F.max(amt).alias("max_purchase_dollars"),
        money_sum(F.when(ty == "Credits package", amt)).alias("_credit_sum"),
        F.min("purchase_time").alias("_first_purchase"),
        F.max("purchase_time").alias("_last_purchase"),
        F.count("purchase_time").alias("_n_time"),
    )
    typed = F.col("_n_typed") > 0
    # plan changes: previous Subscription Update amount of the same user
    upd = p.where(ty == "Subscription Update")
    upd = ordered(upd, "user_id", "purchase_time", "transaction_id",
                  lags={"amt": F.col("amt")}, chunk_rows=chunk_rows)
    delta = F.col("amt") - F.col("lag_amt")
    chg = upd.groupBy("user_id").agg(cnt(delta > 0).alias("_up"), cnt(delta < 0).alias("_down"))
    out = agg.join(chg, "user_id", "left")
    span_days = (micros("_last_purchase") - micros("_first_purchase")) / F.lit(float(US_PER_DAY))
    return out.select(
        "user_id", "n_purchases_total",
        F.when(typed, F.col("_creates")).alias("n_subscription_creates"),
        F.when(typed, F.col("_updates")).alias("n_subscription_updates"),
        F.when(typed, F.col("_credits")).alias("n_credit_package_purchases"),
        F.when(typed, F.col("_upsells")).alias("n_upsell_purchases"),
        F.when(typed, (F.col("_react") > 0).cast("long")).alias("has_reactivation_purchase"),
        F.when(typed, safe_div("_credits", "n_purchases_total")).otherwise(F.lit(0.0))
         .alias("pct_credit_package_purchases"),
        F.coalesce(F.col("_sum"), F.lit(0.0)).alias("total_purchase_dollars"),
        "avg_purchase_dollars", "max_purchase_dollars",
        F.when(F.col("_credits") > 0, F.coalesce(F.col("_credit_sum"), F.lit(0.0)))
         .alias("credit_package_spend_total"),
        floor_days(obs_ts(obs_date), "_last_purchase").alias("days_since_last_purchase"),
        F.when(F.col("_n_time") >= 2, span_days / (F.col("_n_time") - 1)).alias("avg_days_between_purchases"),
        F.when(F.col("_up") > 0, F.lit(1)).cast("long").alias("has_plan_upgrade"),
        F.when(F.col("_down") > 0, F.lit(1)).cast("long").alias("has_plan_downgrade"),
        F.when(typed, F.col("_updates")).alias("n_plan_changes"),
        "_first_purchase", "_last_purchase",
    )


# --------------------------------------------------------------------------- 2.8
def build_transaction_features(transactions: DataFrame, purchases: DataFrame, obs_date: str, *,
                               chunk_rows: int | None = None) -> DataFrame:
    obs = obs_ts(obs_date)
    obs_us = micros(obs)
    t = transactions
    fail = F.col("is_failed")
    succ = F.col("is_successful")
    code = F.col("failure_code")
    amt = F.col("amount_in_usd").cast("double")
    us = micros("transaction_time")
    recent = us >= obs_us - cfg.TXN_RECENT_WINDOW_DAYS * US_PER_DAY
    wallet = F.col("digital_wallet")

    def any_true(c):
        return F.coalesce(F.bool_or(F.col(c).cast("double") != 0), F.lit(False)).cast("long")

    agg = t.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_total_transaction_attempts"),
        cnt(succ).alias("_n_succ"), cnt(fail).alias("_n_fail"),
        F.min(F.struct(F.col("transaction_time").isNull(), "transaction_time", "transaction_id",
                       fail.cast("long").alias("v"))).getField("v").alias("first_transaction_was_failure"),
        cnt(recent).alias("_n_recent"), cnt(recent & fail).alias("_n_recent_fail"),
        cnt(code == "card_declined").alias("_declined"),
        cnt(code.isin("incorrect_cvc", "invalid_cvc")).alias("_cvc"),
        cnt(code == "expired_card").alias("_expired"),
        cnt(code == "authentication_required").alias("_auth"),
        cnt(code == "processing_error").alias("_proc"),
        F.mode(F.when(fail, code), True).alias("dominant_failure_code"),
        any_true("is_prepaid").alias("uses_prepaid_card"),
        any_true("is_virtual").alias("uses_virtual_card"),
        any_true("is_business").alias("uses_business_card"),
        F.coalesce(F.bool_or((wallet != "none") & wallet.isNotNull()), F.lit(False)).cast("long")
         .alias("uses_digital_wallet"),
        F.mode("card_funding", True).alias("card_funding_type"),
        F.mode("card_brand", True).alias("dominant_card_brand"),
        F.mode("billing_address_country", True).alias("dominant_billing_country"),
        cnt(F.col("is_prepaid").cast("double") == 1).alias("_n_prepaid"),
        cnt((F.col("is_3d_secure") == F.lit(True)) & (F.col("is_3d_secure_authenticated") == F.lit(False)))
         .alias("_n_3ds"),
        cnt(F.col("cvc_check") == "fail").alias("_n_cvc_fail"),
        cnt(F.col("cvc_check") == "unavailable").alias("n_cvc_unavailable"),
        F.sum(F.when(succ, amt)).alias("_succ_sum"),
        F.avg(amt).alias("avg_transaction_amount_usd"),
        cnt(succ & (amt > cfg.HIGH_VALUE_USD)).alias("_n_hv"),
        F.max(F.when(fail, F.col("transaction_time"))).alias("_last_fail"),
        F.max(F.when(succ, F.col("transaction_time"))).alias("_last_succ"),
    )
    # distinct failed amounts, pre-aggregated by (user, amount): amounts are no bounded set
    amounts = (t.where(fail & amt.isNotNull()).select("user_id", amt.alias("_amt")).distinct()
               .groupBy("user_id").agg(F.count(F.lit(1)).alias("_n_amts")))
    # failed attempts whose id never shows up as a purchase (anti join on the id)
    pids = purchases.select("transaction_id").where(F.col("transaction_id").isNotNull()).distinct()
    nomatch = (t.where(fail).select("user_id", "transaction_id")
               .join(pids, "transaction_id", "left_anti")
               .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_failed_without_matching_purchase")))
    # retries: failure <= 24 h after the previous failure of the same user and amount
    f = t.where(fail & F.col("amount_in_usd").isNotNull()).select(
        "user_id", "transaction_id", "transaction_time", amt.alias("_amt"))
    f = ordered(f, ["user_id", "_amt"], "transaction_time", "transaction_id",
                lags={"us": micros("transaction_time")}, chunk_rows=chunk_rows)
    hrs = (micros("transaction_time") - F.col("lag_us")) / F.lit(float(US_PER_HOUR))
    retry = f.groupBy("user_id").agg(cnt(hrs <= cfg.RETRY_WINDOW_HOURS).alias("_retry"))

    out = agg.join(nomatch, "user_id", "left").join(retry, "user_id", "left").join(amounts, "user_id", "left")
    n_tot = F.col("n_total_transaction_attempts")
    n_fail = F.col("_n_fail")
    rate = safe_div("_n_fail", n_tot)
    rate_recent = F.when(F.col("_n_recent") > 0, F.col("_n_recent_fail") / F.col("_n_recent"))
    return out.select(
        "user_id",
        F.when(n_fail > 0, (F.col("_n_succ") == 0).cast("long")).alias("has_failed_but_no_successful_payment"),
        "n_failed_without_matching_purchase",
        "first_transaction_was_failure",
        F.when(n_fail > 0, F.coalesce("_n_amts", F.lit(0))).alias("n_distinct_amounts_attempted"),
        "n_total_transaction_attempts",
        nullif_zero("_n_succ").alias("n_successful_transactions"),
        nullif_zero("_n_fail").alias("n_failed_transactions"),
        rate.alias("transaction_failure_rate"),
        rate_recent.alias("transaction_failure_rate_recent"),
        (rate_recent - rate).alias("failure_rate_acceleration"),
        nullif_zero("_declined").alias("n_card_declined"),
        nullif_zero("_cvc").alias("n_cvc_failures"),
        nullif_zero("_expired").alias("n_expired_card"),
        nullif_zero("_auth").alias("n_auth_required_failures"),
        nullif_zero("_proc").alias("n_processing_errors"),
        "dominant_failure_code",
        nullif_zero("_retry").alias("payment_retry_count"),
        "uses_prepaid_card", "uses_virtual_card", "uses_business_card", "uses_digital_wallet",
        "card_funding_type", "dominant_card_brand", "dominant_billing_country",
        safe_div("_n_prepaid", n_tot).alias("pct_prepaid_transactions"),
        nullif_zero("_n_3ds").alias("n_3d_secure_friction"),
        F.when(F.col("_n_cvc_fail") > 0, F.lit(1)).cast("long").alias("has_any_cvc_failure"),
        safe_div("_n_cvc_fail", n_tot).alias("cvc_fail_rate"),
        "n_cvc_unavailable",
        F.when(F.col("_n_succ") > 0, F.coalesce(F.col("_succ_sum"), F.lit(0.0))).alias("total_transaction_amount_usd"),
        "avg_transaction_amount_usd",
        nullif_zero("_n_hv").alias("n_high_value_transactions"),
        floor_days(obs, "_last_fail").alias("days_since_last_failed_transaction"),
        floor_days(obs, "_last_succ").alias("days_since_last_successful_transaction"),
    )


# --------------------------------------------------------------------------- 2.9
def build_quiz_features(quizzes: DataFrame) -> DataFrame:
    q = dedupe_first(quizzes.select("user_id", *cfg.QUIZ_FIELDS), "user_id", cfg.QUIZ_FIELDS)
    src = norm_lower("source")
    usage = norm_lower("usage_plan")
    frust = frustration_canon("frustration")
    role = norm_lower("role")
    depth = sum(F.col(c).isNotNull().cast("long") for c in cfg.QUIZ_FIELDS)
    return q.select(
        "user_id",
        depth.alias("quiz_completion_depth"),
        F.coalesce(map_lookup(cfg.SOURCE_INTENT, src), F.lit(1)).cast("long").alias("acquisition_channel_intent"),
        encode_top_n("source", cfg.TOP_SOURCES).alias("source_encoded"),
        team_size_ordinal("team_size").cast("long").alias("team_size_ordinal"),
        experience_ordinal("experience").cast("long").alias("experience_ordinal"),
        flag(usage.isin(cfg.COMMERCIAL_USAGE_PLANS)).cast("long").alias("usage_plan_commercial"),
        F.coalesce(usage, F.lit("unknown")).alias("usage_plan_encoded"),
        flag(frust == "high-cost").cast("long").alias("frustrated_cost"),
        flag(frust == "inconsistent").cast("long").alias("frustrated_quality"),
        flag(frust == "limited").cast("long").alias("frustrated_limited"),
        flag(frust.isin("confusing", "hard-prompt")).cast("long").alias("frustrated_confusing"),
        flag(F.lower("first_feature").contains("video")).cast("long").alias("first_feature_video"),
        encode_top_n("first_feature", cfg.TOP_FIRST_FEATURES).alias("first_feature_encoded"),
        F.coalesce(map_lookup(cfg.ROLE_COMMITMENT, role), F.lit(0)).cast("long").alias("role_commitment_score"),
        F.coalesce(role, F.lit("unknown")).alias("role_encoded"),
    )
