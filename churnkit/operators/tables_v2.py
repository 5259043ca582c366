"""v2 roll-ups (section 2.10): payment distress and recent-silence signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import US_PER_DAY, clip_lower, cnt, floor_days, micros, nullif_zero, safe_div
from .generations import obs_ts, tenure_days
from .ordered import ordered


def build_transaction_features_v2(transactions: DataFrame, obs_date: str, *,
                                  chunk_rows: int | None = None) -> DataFrame:
    """One row per user with any payment attempt.

    The longest failure streak is a gaps-and-islands count: an island is
    identified by the number of successes before the row (a running sum
    from the chunked ordering), and a streak is the failures of one island.
    """
    obs = obs_ts(obs_date)
    obs_us = micros(obs)
    t = transactions.select("user_id", "transaction_id", "transaction_time", "is_failed", "is_successful")
    fail = F.col("is_failed")
    us = micros("transaction_time")
    o = ordered(t, "user_id", "transaction_time", "transaction_id",
                sums_before={"succ": F.col("is_successful").cast("long")}, chunk_rows=chunk_rows)
    streak = (o.where(fail).groupBy("user_id", "before_succ").agg(F.count(F.lit(1)).alias("_len"))
               .groupBy("user_id").agg(F.max("_len").alias("n_consecutive_payment_failures")))
    agg = t.groupBy("user_id").agg(
        F.max(F.struct(F.col("transaction_time").isNull(), "transaction_time", "transaction_id",
                       fail.cast("long").alias("v"))).getField("v").alias("last_transaction_was_failure"),
        cnt(F.col("is_successful")).alias("_n_succ"),
        cnt(fail).alias("_n_fail"),
        cnt(fail & (us >= obs_us - 7 * US_PER_DAY)).alias("_f7"),
        cnt(fail & (us >= obs_us - 14 * US_PER_DAY)).alias("_f14"),
        F.min(F.when(fail, F.col("transaction_time"))).alias("_first_fail"),
    )
    out = agg.join(streak, "user_id", "left")
    return out.select(
        "user_id", "n_consecutive_payment_failures", "last_transaction_was_failure",
        F.when(F.col("_n_succ") > 0, F.lit(1)).cast("long").alias("has_ever_successfully_paid"),
        nullif_zero("_f7").alias("n_failed_last_7d"),
        nullif_zero("_f14").alias("n_failed_last_14d"),
        floor_days(obs, "_first_fail").alias("days_from_first_fail_to_obs"),
        F.when(F.col("_n_fail") > 0, safe_div("_f7", "_n_fail")).alias("recent_fail_concentration"),
    )


def build_generation_features_v2(gens: DataFrame, props: DataFrame, obs_date: str) -> DataFrame:
    """One row per property user.

    Active days in the last 30 days are a ``groupBy(user, date)`` (partial
    aggregation, so a hot user is pre-reduced map-side); the gap window then
    runs over at most one row per user-day, which is bounded by the number
    of calendar days, not by the user's event count."""
    obs = obs_ts(obs_date)
    obs_us = micros(obs)
    g = gens.select("user_id", "created_at", "status")
    us = micros("created_at")
    day = F.to_date("created_at")
    days30 = (g.where(us >= obs_us - 30 * US_PER_DAY).groupBy("user_id", day.alias("_d")).agg(F.lit(1).alias("_x")))
    w = Window.partitionBy("user_id").orderBy("_d")
    gaps = days30.withColumn("_gap", F.datediff("_d", F.lag("_d").over(w)))
    act30 = gaps.groupBy("user_id").agg(F.max("_gap").cast("long").alias("_maxgap"),
                                        F.count(F.lit(1)).alias("_ndays"))
    completed = F.coalesce(F.col("status") == "completed", F.lit(False))
    last14 = us >= obs_us - 14 * US_PER_DAY
    agg = g.groupBy("user_id").agg(
        F.max(F.when(completed, F.col("created_at"))).alias("_last_completed"),
        cnt(last14).alias("_t14"), cnt(last14 & completed).alias("_c14"),
        cnt(us >= obs_us - 7 * US_PER_DAY).alias("_l7"),
        F.count(F.lit(1)).alias("_tot"),
        F.max(day).alias("_last_day"),
    )
    users = props.select("user_id", tenure_days(F.col("subscription_start_date"), obs_date).alias("_ten"))
    out = users.join(act30, "user_id", "left").join(agg, "user_id", "left")
    ten = F.col("_ten")
    avg7 = F.try_divide(F.col("_tot").cast("double"), F.nullif(ten / F.lit(7.0), F.lit(0.0)))
    silence = clip_lower(floor_days(obs, F.col("_last_day").cast("timestamp")), 0)
    return out.select(
        "user_id",
        F.coalesce(F.col("_maxgap"), F.lit(30)).cast("long").alias("max_gap_days_last_30"),
        F.coalesce(clip_lower(F.lit(30) - F.col("_ndays"), 0), F.lit(30)).cast("long")
         .alias("zero_gen_days_last_30"),
        floor_days(obs, "_last_completed").alias("days_since_last_completed_gen"),
        F.when(F.col("_t14") > 0, F.col("_c14") / F.col("_t14")).alias("completion_rate_last14"),
        F.pmod(ten, F.lit(30)).cast("long").alias("plan_renewal_proximity_days"),
        safe_div(F.coalesce(F.col("_l7"), F.lit(0)).cast("double"), avg7 + F.lit(0.1)).alias("gens_last7_pct_of_avg"),
        F.coalesce(silence, ten).cast("long").alias("trailing_silence_days"),
    )
