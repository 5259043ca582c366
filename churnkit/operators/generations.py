"""Generation-event roll-up (v1, section 2.6): one row per property user.

Plan shape (one scan of the event table, all joins at user or chunk level):

1. :func:`ordered.ordered` deals the events into chunks of equal depth and
   adds the event's position from the end (last-10 failure rate), the previous
   completed event's time (gap hours), the user's row count, first and last time
   and subscription start - no whole-user window, no row-level join on the user.
   The annotated rows are stored once for both passes below.
2. one wide ``groupBy(user_id).agg`` with partial aggregation for all
   counts, rates, recency, windows, modes and the weekly OLS sums.
3. per-day counts (``groupBy(user, date)``) for active days and the CV,
   and exact medians via ranked chunks (:func:`ordered.group_median`).

Null rules follow the original: a user without events is NULL for most
columns, but 0 for ``credit_burn_rate``, ``active_days_fraction`` and
``generation_frequency_daily``; ``fill_absent=True`` turns all of that
user's numeric NULLs into 0 instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.core import (US_PER_DAY, US_PER_HOUR, clip_lower, cnt, floor_div, floor_days,
                              micros, nullif_zero, safe_div)
from ..session import stored
from .ordered import group_median, ordered


def obs_ts(obs_date: str):
    return F.lit(obs_date).cast("timestamp")


def tenure_days(start, obs_date: str):
    """``(obs - start).dt.days.clip(lower=1)``."""
    return clip_lower(floor_days(obs_ts(obs_date), start), 1)


def _proc_seconds() -> F.Column:
    """Processing seconds: the column when given, else completed_at - created_at."""
    derived = (micros("completed_at") - micros("created_at")) / F.lit(1e6)
    return F.coalesce(F.col("processing_time_sec").cast("double"), derived)


def build_generation_features(gens: DataFrame, props: DataFrame, obs_date: str, *,
                              fill_absent: bool = False, chunk_rows: int | None = None) -> DataFrame:
    obs = obs_ts(obs_date)
    obs_us = micros(obs)
    g = gens.select("user_id", "generation_id", "created_at", "completed_at", "status",
                    "generation_type", "resolution", "credit_cost", "credit_cost_filled",
                    "is_free_model", "is_video", "is_image", "aspect_ration", "duration",
                    "processing_time_sec")
    start = props.select("user_id", F.col("subscription_start_date").alias("_start"))

    st = F.col("status")
    completed = F.coalesce(st == "completed", F.lit(False))
    rows = ordered(g, "user_id", "created_at", "generation_id",
                   maxes_before={"comp": F.when(completed & F.col("created_at").isNotNull(),
                                                micros("created_at"))},
                   chunk_rows=chunk_rows, stats=start)
    # the annotated rows feed both the wide aggregate and the median pass
    rows = stored(rows, "generation-rows")

    us = micros("created_at")
    t0, t1 = F.col("_t0").cast("long"), F.col("_t1").cast("long")
    start_us = micros("_start")
    day14 = cfg.RECENT_WINDOW_DAYS * US_PER_DAY
    last14 = us >= obs_us - day14
    prior14 = (us >= obs_us - 2 * day14) & (us < obs_us - day14)
    failed = F.coalesce(st == "failed", F.lit(False))
    free = F.col("is_free_model")
    cost = F.col("credit_cost")
    proc = _proc_seconds()
    week = clip_lower(floor_div(floor_div(us - start_us, US_PER_DAY), 7), 0)
    hour = F.hour("created_at")
    weekday = F.weekday("created_at")  # 0 = Monday
    is_wd = F.coalesce(weekday < 5, F.lit(False))
    bh0, bh1 = cfg.BUSINESS_HOURS
    gap_h = F.when(completed, (us - F.col("maxbefore_comp")) / F.lit(float(US_PER_HOUR)))

    agg = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_generations"),
        F.count(st).alias("_n_status"),
        cnt(completed).alias("_n_completed"),
        cnt(failed).alias("_n_failed"),
        cnt(st == "nsfw").alias("_n_nsfw"),
        cnt(st == "canceled").alias("_n_canceled"),
        cnt(st.isin("queued", "waiting", "in_progress")).alias("_n_queued"),
        F.avg(F.when(F.col("_pos_desc") <= 10, failed.cast("double"))).alias("failure_rate_last_10"),
        cnt(free).alias("_n_free"),
        cnt(~free).alias("_n_paid"),
        F.sum("credit_cost_filled").alias("total_credits_consumed"),
        F.avg(F.when(~free, cost)).alias("avg_credit_cost_per_gen"),
        cnt(last14).alias("_n_l14"), cnt(prior14).alias("_n_p14"),
        F.sum(F.when(last14, F.col("credit_cost_filled"))).alias("_c_l14"),
        F.sum(F.when(prior14, F.col("credit_cost_filled"))).alias("_c_p14"),
        cnt(~free & (cost > cfg.HIGH_CREDIT_COST)).alias("_n_premium"),
        cnt(F.col("is_video")).alias("_n_video"),
        cnt(F.col("is_image")).alias("_n_image"),
        F.size(F.collect_set("generation_type")).cast("long").alias("n_unique_generation_types"),
        F.min(F.when(F.col("generation_type").isNotNull(),
                     F.struct(F.col("created_at").isNull(), "created_at", "generation_id",
                              "generation_type"))).getField("generation_type").alias("_first_type"),
        F.max(F.when(F.col("generation_type").isNotNull(),
                     F.struct(F.col("created_at").isNull(), "created_at", "generation_id",
                              "generation_type"))).getField("generation_type").alias("_last_type"),
        F.mode("generation_type", True).alias("dominant_generation_type"),
        cnt(F.col("generation_type") == "image_model_1").alias("_n_im1"),
        F.avg(F.when(F.col("is_video"), F.col("duration").cast("double"))).alias("avg_video_duration"),
        F.count(F.col("resolution")).alias("_n_res"),
        cnt(F.col("resolution").isin("4k", "2k")).alias("_n_hires"),
        F.mode("aspect_ration", True).alias("dominant_aspect_ratio"),
        F.avg(F.when(completed, proc)).alias("avg_processing_time_sec"),
        cnt(completed & (proc > cfg.LONG_WAIT_SECS)).alias("_n_long"),
        F.max(F.col("_t0")).alias("_first_us"), F.max(F.col("_t1")).alias("_last_us"),
        F.first("_start", ignorenulls=True).alias("_start"),
        cnt(us <= start_us + cfg.ACTIVATION_WINDOW_DAYS * US_PER_DAY).alias("_n_first7"),
        cnt(us >= obs_us - 7 * US_PER_DAY).alias("_n_last7"),
        cnt(2 * (us - t0) <= t1 - t0).alias("_n_half1"),
        cnt(2 * (us - t0) > t1 - t0).alias("_n_half2"),
        # weekly OLS sums over distinct weeks; y = rows per week
        F.collect_set(week).alias("_weeks"),
        F.count(week).alias("_sy"),
        F.sum(week).alias("_sxy"),
        F.avg(gap_h).alias("avg_inter_generation_hours"),
        cnt(is_wd & hour.between(bh0, bh1)).alias("_n_biz"),
        cnt(is_wd).alias("_n_wd"),
        F.mode(hour, True).alias("_mode_hour"),
    )

    tot = F.col("total_generations")
    has_status = F.col("_n_status") > 0
    weeks = F.col("_weeks")
    n_w = F.size(weeks).cast("long")
    sx = F.aggregate(weeks, F.lit(0).cast("long"), lambda a, x: a + x)
    sx2 = F.aggregate(weeks, F.lit(0).cast("long"), lambda a, x: a + x * x)
    denom = n_w * sx2 - sx * sx
    slope = F.when(n_w < 3, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide((n_w * F.col("_sxy") - sx * F.col("_sy")).cast("double"),
                                F.nullif(denom, F.lit(0)).cast("double")), F.lit(0.0)))
    l14, p14 = F.col("_n_l14"), F.col("_n_p14")
    either = (l14 > 0) | (p14 > 0)
    both = (l14 > 0) & (p14 > 0)
    g_feat = agg.select(
        "user_id", "total_generations",
        F.when(has_status, F.col("_n_completed")).alias("n_completed"),
        F.when(has_status, F.col("_n_failed")).alias("n_failed"),
        F.when(has_status, F.col("_n_nsfw")).alias("n_nsfw"),
        F.when(has_status, F.col("_n_canceled")).alias("n_canceled"),
        F.when(has_status, F.col("_n_queued")).alias("n_queued_or_waiting"),
        safe_div("_n_completed", tot).alias("completion_rate"),
        safe_div("_n_failed", tot).alias("failure_rate_overall"),
        "failure_rate_last_10",
        (F.col("failure_rate_last_10") - safe_div("_n_failed", tot)).alias("failure_rate_delta"),
        safe_div("_n_nsfw", tot).alias("nsfw_rate"),
        safe_div("_n_canceled", tot).alias("cancellation_rate"),
        safe_div("_n_free", tot).alias("pct_free_model_usage"),
        nullif_zero("_n_paid").alias("n_credit_costing_gens"),
        "total_credits_consumed", "avg_credit_cost_per_gen",
        F.when(both, safe_div("_c_l14", F.col("_c_p14") + 1)).when(either, F.lit(0.0))
         .alias("credit_burn_acceleration"),
        F.when(F.col("_n_paid") > 0, F.col("_n_premium") / F.col("_n_paid")).alias("premium_gen_ratio"),
        safe_div("_n_video", tot).alias("video_generation_ratio"),
        safe_div("_n_image", tot).alias("image_generation_ratio"),
        "n_unique_generation_types",
        (F.coalesce(F.col("_first_type").startswith("image_"), F.lit(False))
         & F.coalesce(F.col("_last_type").startswith("video_"), F.lit(False))).cast("long")
         .alias("video_to_image_graduation"),
        safe_div("_n_im1", tot).alias("image_model_1_share"),
        "avg_video_duration",
        F.when(F.col("_n_res") > 0, F.col("_n_hires") / F.col("_n_res")).alias("pct_high_resolution"),
        "dominant_aspect_ratio",
        "avg_processing_time_sec",
        F.when(has_status, safe_div("_n_long", "_n_completed")).alias("pct_long_wait_gens"),
        floor_div(obs_us - F.col("_last_us").cast("long"), US_PER_DAY).alias("days_since_last_generation"),
        clip_lower(floor_div(F.col("_first_us").cast("long") - micros("_start"), US_PER_DAY), 0)
         .alias("days_to_first_generation"),
        clip_lower(floor_div(F.col("_last_us").cast("long") - F.col("_first_us").cast("long"),
                              US_PER_DAY), 0).alias("generation_span_days"),
        nullif_zero("_n_first7").alias("gens_first_7_days"),
        nullif_zero("_n_last7").alias("gens_last_7_days"),
        F.when(F.col("_first_us").isNotNull(), safe_div("_n_half2", F.col("_n_half1") + 1))
         .alias("engagement_trajectory_ratio"),
        F.when(F.col("_sy") > 0, slope).alias("engagement_slope"),
        F.when(both, l14 / (p14 + 1)).when(either, F.lit(0.0)).alias("gens_last_14_vs_prior_14"),
        "avg_inter_generation_hours",
        safe_div("_n_biz", tot).alias("pct_gens_business_hours"),
        safe_div("_n_wd", tot).alias("pct_gens_weekdays"),
        F.coalesce(F.col("_mode_hour"), F.lit(0)).cast("long").alias("dominant_usage_hour"),
        "dominant_generation_type",
    )

    # per-day counts: active days and the coefficient of variation
    daily = (g.where(F.col("created_at").isNotNull())
             .groupBy("user_id", F.to_date("created_at").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_active_days"),
                                     F.try_divide(F.stddev_samp("_c"), F.nullif(F.avg("_c"), F.lit(0.0)))
                                     .alias("generation_frequency_cv")))

    # exact medians, one ranked pass over a long (user, metric, value) table
    med_src = rows.select(
        "user_id", "generation_id",
        F.explode(F.array(
            F.struct(F.lit("video").alias("m"),
                     F.when(F.col("is_video"), F.col("duration").cast("double")).alias("v")),
            F.struct(F.lit("proc").alias("m"), F.when(completed, proc).alias("v")),
            F.struct(F.lit("gap").alias("m"), gap_h.alias("v")))).alias("_mv"))
    med_src = med_src.select("user_id", "generation_id", F.col("_mv.m").alias("metric"),
                             F.col("_mv.v").alias("value"))
    med = group_median(med_src, ["user_id", "metric"], "value", "generation_id",
                       chunk_rows=chunk_rows)
    med = med.groupBy("user_id").agg(
        F.max(F.when(F.col("metric") == "video", F.col("median"))).alias("median_video_duration"),
        F.max(F.when(F.col("metric") == "proc", F.col("median"))).alias("median_processing_time_sec"),
        F.max(F.when(F.col("metric") == "gap", F.col("median"))).alias("median_inter_generation_hours"))

    users = props.select("user_id", tenure_days(F.col("subscription_start_date"), obs_date)
                         .alias("_tenure"))
    out = (users.join(g_feat, "user_id", "left")
                .join(daily, "user_id", "left")
                .join(med, "user_id", "left"))
    ten = F.col("_tenure")
    out = (out.withColumn("credit_burn_rate", safe_div("total_credits_consumed", ten))
              .withColumn("active_days_fraction", safe_div("n_active_days", ten))
              .withColumn("avg_gens_per_active_day",
                          F.when(tot.isNotNull(), safe_div(tot, "n_active_days")))
              .withColumn("generation_frequency_daily", safe_div(tot, ten))
              .withColumn("n_active_days", F.when(tot.isNotNull(),
                                                  F.coalesce(F.col("n_active_days"), F.lit(0)))))
    out = out.select("user_id", *GENERATION_COLUMNS)
    if fill_absent:
        out = out.fillna(0)
    return out


#: output order of the v1 generation roll-up
GENERATION_COLUMNS = [
    "total_generations", "n_completed", "n_failed", "n_nsfw", "n_canceled",
    "n_queued_or_waiting", "completion_rate", "failure_rate_overall", "failure_rate_last_10",
    "failure_rate_delta", "nsfw_rate", "cancellation_rate", "pct_free_model_usage",
    "n_credit_costing_gens", "total_credits_consumed", "avg_credit_cost_per_gen",
    "credit_burn_rate", "credit_burn_acceleration", "premium_gen_ratio",
    "video_generation_ratio", "image_generation_ratio", "n_unique_generation_types",
    "video_to_image_graduation", "image_model_1_share", "avg_video_duration",
    "median_video_duration", "pct_high_resolution", "dominant_aspect_ratio",
    "avg_processing_time_sec", "median_processing_time_sec", "pct_long_wait_gens",
    "days_since_last_generation", "days_to_first_generation", "generation_span_days",
    "n_active_days", "active_days_fraction", "gens_first_7_days", "gens_last_7_days",
    "engagement_trajectory_ratio", "engagement_slope", "gens_last_14_vs_prior_14",
    "avg_gens_per_active_day", "generation_frequency_daily", "generation_frequency_cv",
    "avg_inter_generation_hours", "median_inter_generation_hours",
    "pct_gens_business_hours", "pct_gens_weekdays", "dominant_usage_hour",
    "dominant_generation_type",
]
