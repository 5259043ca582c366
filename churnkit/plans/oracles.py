"""DuckDB oracle SQL for the registered queries (run on the driver's tables).

Each oracle restates the feature definitions in plain SQL - windows and
group-bys the straightforward way - so it checks the Spark plans (chunked
ordering, salted joins, one-pass aggregates) against an independent
formulation.  Doubles are rounded to 6 places in both engines.
"""

from __future__ import annotations

from ..sources.fixtures import view_ctes, with_views
from .sqlkit import D, H, OBS, clip_lo, cnt, fdays, fdiv, mode_cte, sdiv


def generations_v1() -> str:
    us_week = f"CASE WHEN us IS NULL OR start_us IS NULL THEN NULL ELSE greatest(0, {fdiv(fdays('us', 'start_us'), 7)}) END"
    sql = f"""
, g AS (
  SELECT g.user_id, g.generation_id, g.created_at, g.status, g.generation_type, g.resolution, g.aspect_ration,
         (epoch_us(g.completed_at) - epoch_us(g.created_at)) / 1e6 AS proc,
         CAST(g.credit_cost AS DOUBLE) AS credit_cost, CAST(g.duration AS DOUBLE) AS duration,
         epoch_us(g.created_at) AS us, epoch_us(p.subscription_start_date) AS start_us,
         coalesce(g.status = 'completed', false) AS completed,
         coalesce(g.status = 'failed', false) AS failed,
         (g.credit_cost IS NULL OR g.credit_cost = 0) AS is_free,
         coalesce(CAST(g.credit_cost AS DOUBLE), CAST(0 AS DOUBLE)) AS cost_filled,
         coalesce(starts_with(g.generation_type, 'video_'), false) AS is_video,
         coalesce(starts_with(g.generation_type, 'image_'), false) AS is_image
  FROM generations g LEFT JOIN properties p ON p.user_id = g.user_id),
last10 AS (
  SELECT user_id, avg(CASE WHEN failed THEN 1.0 ELSE CAST(0 AS DOUBLE) END) AS failure_rate_last_10 FROM (
    SELECT user_id, failed, row_number() OVER (PARTITION BY user_id ORDER BY (us IS NULL) DESC, us DESC, generation_id DESC) AS rn FROM g)
  WHERE rn <= 10 GROUP BY user_id),
gaps AS (
  SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY (us IS NULL), us, generation_id)) / {H}.0 AS gap
  FROM g WHERE completed),
gapagg AS (SELECT user_id, avg(gap) AS avg_inter_generation_hours, CAST(median(gap) AS DOUBLE) AS median_inter_generation_hours FROM gaps GROUP BY user_id),
ft AS (
  SELECT user_id, max(CASE WHEN rn_a = 1 THEN generation_type END) AS first_type,
         max(CASE WHEN rn_d = 1 THEN generation_type END) AS last_type
  FROM (SELECT user_id, generation_type,
          row_number() OVER (PARTITION BY user_id ORDER BY (us IS NULL), us, generation_id) AS rn_a,
          row_number() OVER (PARTITION BY user_id ORDER BY (us IS NULL) DESC, us DESC, generation_id DESC) AS rn_d
        FROM g WHERE generation_type IS NOT NULL) GROUP BY user_id),
{mode_cte('mt', 'g', 'user_id', 'generation_type', alias='dominant_generation_type')},
{mode_cte('mh', 'g', 'user_id', 'hour(created_at)', alias='mode_hour')},
{mode_cte('mar', 'g', 'user_id', 'aspect_ration', alias='dominant_aspect_ratio')},
daily AS (
  SELECT user_id, count(*) AS n_active_days, stddev_samp(c) / nullif(avg(c), 0) AS generation_frequency_cv
  FROM (SELECT user_id, CAST(created_at AS DATE) AS d, count(*) AS c FROM g WHERE created_at IS NOT NULL GROUP BY 1, 2)
  GROUP BY user_id),
weekly AS (
  SELECT user_id, wk, count(*) AS c FROM (SELECT user_id, {us_week} AS wk FROM g) WHERE wk IS NOT NULL GROUP BY 1, 2),
slope AS (
  SELECT user_id, count(*) AS n, sum(wk) AS sx, sum(c) AS sy, sum(wk * c) AS sxy, sum(wk * wk) AS sx2 FROM weekly GROUP BY user_id),
fl AS (SELECT user_id, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY user_id),
halves AS (
  SELECT g.user_id, {cnt('2 * (g.us - fl.first_us) <= fl.last_us - fl.first_us')} AS h1,
         {cnt('2 * (g.us - fl.first_us) > fl.last_us - fl.first_us')} AS h2
  FROM g JOIN fl ON fl.user_id = g.user_id GROUP BY g.user_id),
agg AS (
  SELECT user_id, count(*) AS total_generations, count(status) AS n_status,
    count_if(completed) AS nc, count_if(failed) AS nf, {cnt("status = 'nsfw'")} AS nn,
    {cnt("status = 'canceled'")} AS ncan, {cnt("status IN ('queued','waiting','in_progress')")} AS nq,
    count_if(is_free) AS n_free, count_if(NOT is_free) AS n_paid,
    sum(cost_filled) AS total_credits_consumed,
    avg(CASE WHEN NOT is_free THEN credit_cost END) AS avg_credit_cost_per_gen,
    {cnt(f'us >= {OBS} - 14 * {D}')} AS l14,
    {cnt(f'us >= {OBS} - 28 * {D} AND us < {OBS} - 14 * {D}')} AS p14,
    sum(CASE WHEN us >= {OBS} - 14 * {D} THEN cost_filled END) AS c_l14,
    sum(CASE WHEN us >= {OBS} - 28 * {D} AND us < {OBS} - 14 * {D} THEN cost_filled END) AS c_p14,
    {cnt('NOT is_free AND credit_cost > 30')} AS n_premium,
    count_if(is_video) AS n_video, count_if(is_image) AS n_image,
    count(DISTINCT generation_type) AS n_unique_generation_types,
    {cnt("generation_type = 'image_model_1'")} AS n_im1,
    avg(CASE WHEN is_video THEN duration END) AS avg_video_duration,
    CAST(median(duration) FILTER (WHERE is_video AND duration IS NOT NULL) AS DOUBLE) AS median_video_duration,
    count(resolution) AS n_res, {cnt("resolution IN ('4k','2k')")} AS n_hires,
    avg(CASE WHEN completed THEN proc END) AS avg_processing_time_sec,
    CAST(median(proc) FILTER (WHERE completed AND proc IS NOT NULL) AS DOUBLE) AS median_processing_time_sec,
    {cnt('completed AND proc > 300')} AS n_long,
    min(us) AS first_us, max(us) AS last_us, any_value(start_us) AS start_us,
    {cnt(f'us <= start_us + 7 * {D}')} AS n_first7,
    {cnt(f'us >= {OBS} - 7 * {D}')} AS n_last7,
    {cnt('isodow(created_at) <= 5 AND hour(created_at) BETWEEN 9 AND 18')} AS n_biz,
    {cnt('isodow(created_at) <= 5')} AS n_wd
  FROM g GROUP BY user_id),
props AS (
  SELECT user_id, {clip_lo(fdays(OBS, 'epoch_us(subscription_start_date)'), 1)} AS tenure FROM properties)
SELECT p.user_id,
  a.total_generations,
  CASE WHEN a.n_status > 0 THEN a.nc END AS n_completed,
  CASE WHEN a.n_status > 0 THEN a.nf END AS n_failed,
  CASE WHEN a.n_status > 0 THEN a.nn END AS n_nsfw,
  CASE WHEN a.n_status > 0 THEN a.ncan END AS n_canceled,
  CASE WHEN a.n_status > 0 THEN a.nq END AS n_queued_or_waiting,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.nc', 'a.total_generations')} END, 6) AS completion_rate,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.nf', 'a.total_generations')} END, 6) AS failure_rate_overall,
  round(l.failure_rate_last_10, 6) AS failure_rate_last_10,
  round(l.failure_rate_last_10 - {sdiv('a.nf', 'a.total_generations')}, 6) AS failure_rate_delta,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.nn', 'a.total_generations')} END, 6) AS nsfw_rate,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.ncan', 'a.total_generations')} END, 6) AS cancellation_rate,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_free', 'a.total_generations')} END, 6) AS pct_free_model_usage,
  nullif(a.n_paid, 0) AS n_credit_costing_gens,
  round(a.total_credits_consumed, 6) AS total_credits_consumed,
  round(a.avg_credit_cost_per_gen, 6) AS avg_credit_cost_per_gen,
  round({sdiv('a.total_credits_consumed', 'p.tenure')}, 6) AS credit_burn_rate,
  round(CASE WHEN a.l14 > 0 AND a.p14 > 0 THEN {sdiv('a.c_l14', 'a.c_p14 + 1')} WHEN a.l14 > 0 OR a.p14 > 0 THEN CAST(0 AS DOUBLE) END, 6) AS credit_burn_acceleration,
  round(CASE WHEN a.n_paid > 0 THEN a.n_premium / a.n_paid END, 6) AS premium_gen_ratio,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_video', 'a.total_generations')} END, 6) AS video_generation_ratio,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_image', 'a.total_generations')} END, 6) AS image_generation_ratio,
  a.n_unique_generation_types,
  CASE WHEN a.user_id IS NOT NULL THEN CAST(coalesce(starts_with(ft.first_type, 'image_'), false) AND coalesce(starts_with(ft.last_type, 'video_'), false) AS BIGINT) END AS video_to_image_graduation,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_im1', 'a.total_generations')} END, 6) AS image_model_1_share,
  round(a.avg_video_duration, 6) AS avg_video_duration,
  round(a.median_video_duration, 6) AS median_video_duration,
  round(CASE WHEN a.n_res > 0 THEN a.n_hires / a.n_res END, 6) AS pct_high_resolution,
  mar.dominant_aspect_ratio,
  round(a.avg_processing_time_sec, 6) AS avg_processing_time_sec,
  round(a.median_processing_time_sec, 6) AS median_processing_time_sec,
  round(CASE WHEN a.n_status > 0 THEN {sdiv('a.n_long', 'a.nc')} END, 6) AS pct_long_wait_gens,
  {fdays(OBS, 'a.last_us')} AS days_since_last_generation,
  {clip_lo(fdays('a.first_us', 'a.start_us'), 0)} AS days_to_first_generation,
  {clip_lo(fdays('a.last_us', 'a.first_us'), 0)} AS generation_span_days,
  CASE WHEN a.user_id IS NOT NULL THEN coalesce(dl.n_active_days, 0) END AS n_active_days,
  round({sdiv('dl.n_active_days', 'p.tenure')}, 6) AS active_days_fraction,
  nullif(a.n_first7, 0) AS gens_first_7_days,
  nullif(a.n_last7, 0) AS gens_last_7_days,
  round(CASE WHEN a.first_us IS NOT NULL THEN {sdiv('h.h2', 'h.h1 + 1')} END, 6) AS engagement_trajectory_ratio,
  round(CASE WHEN s.n IS NULL THEN NULL WHEN s.n < 3 THEN CAST(0 AS DOUBLE) ELSE coalesce(CAST(s.n * s.sxy - s.sx * s.sy AS DOUBLE) / nullif(CAST(s.n * s.sx2 - s.sx * s.sx AS DOUBLE), 0), CAST(0 AS DOUBLE)) END, 6) AS engagement_slope,
  round(CASE WHEN a.l14 > 0 AND a.p14 > 0 THEN a.l14 / (a.p14 + 1) WHEN a.l14 > 0 OR a.p14 > 0 THEN CAST(0 AS DOUBLE) END, 6) AS gens_last_14_vs_prior_14,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.total_generations', 'dl.n_active_days')} END, 6) AS avg_gens_per_active_day,
  round({sdiv('a.total_generations', 'p.tenure')}, 6) AS generation_frequency_daily,
  round(dl.generation_frequency_cv, 6) AS generation_frequency_cv,
  round(ga.avg_inter_generation_hours, 6) AS avg_inter_generation_hours,
  round(ga.median_inter_generation_hours, 6) AS median_inter_generation_hours,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_biz', 'a.total_generations')} END, 6) AS pct_gens_business_hours,
  round(CASE WHEN a.user_id IS NOT NULL THEN {sdiv('a.n_wd', 'a.total_generations')} END, 6) AS pct_gens_weekdays,
  CASE WHEN a.user_id IS NOT NULL THEN CAST(coalesce(mh.mode_hour, 0) AS BIGINT) END AS dominant_usage_hour,
  mt.dominant_generation_type
FROM props p
LEFT JOIN agg a ON a.user_id = p.user_id
LEFT JOIN last10 l ON l.user_id = p.user_id
LEFT JOIN gapagg ga ON ga.user_id = p.user_id
LEFT JOIN ft ON ft.user_id = p.user_id
LEFT JOIN mar ON mar.user_id = p.user_id
LEFT JOIN mt ON mt.user_id = p.user_id
LEFT JOIN mh ON mh.user_id = p.user_id
LEFT JOIN daily dl ON dl.user_id = p.user_id
LEFT JOIN slope s ON s.user_id = p.user_id
LEFT JOIN halves h ON h.user_id = p.user_id
"""
    return view_ctes("users", "properties", "generations") + sql


def _tenure(start_us: str) -> str:
    return clip_lo(fdays(OBS, start_us), 1)


def subscription_v1() -> str:
    from .. import config as cfg
    from .sqlkit import case_map, top_n
    plan = "subscription_plan"
    cc = "trim(upper(country_code))"
    return view_ctes("users", "properties") + f"""
SELECT user_id,
  CAST({case_map(plan, {k: v[0] for k, v in cfg.PLAN_INFO.items()})} AS DOUBLE) AS plan_ordinal,
  CAST({case_map(plan, {k: v[1] for k, v in cfg.PLAN_INFO.items()})} AS DOUBLE) AS plan_monthly_credits,
  CAST({case_map(plan, {k: v[2] for k, v in cfg.PLAN_INFO.items()})} AS DOUBLE) AS plan_monthly_cost_usd,
  {_tenure('epoch_us(subscription_start_date)')} AS tenure_days,
  CAST(month(subscription_start_date) AS BIGINT) AS subscription_start_month,
  CAST(isodow(subscription_start_date) - 1 AS BIGINT) AS subscription_start_dayofweek,
  {top_n(cc, cfg.TOP_COUNTRIES)} AS country_encoded
FROM properties"""


def purchases_v1(helpers: bool = False) -> str:
    return view_ctes("purchases") + f"""
, p AS (SELECT user_id, transaction_id, purchase_time, purchase_type,
               CAST(purchase_amount_dollars AS DOUBLE) AS amt, epoch_us(purchase_time) AS us FROM purchases),
upd AS (SELECT user_id, amt - lag(amt) OVER (PARTITION BY user_id ORDER BY (us IS NULL), us, transaction_id) AS delta
        FROM p WHERE purchase_type = 'Subscription Update'),
chg AS (SELECT user_id, count_if(delta > 0) AS up, count_if(delta < 0) AS down FROM upd GROUP BY user_id),
agg AS (
  SELECT user_id, count(*) AS n, count(purchase_type) AS nt,
    {cnt("purchase_type = 'Subscription Create'")} AS creates,
    {cnt("purchase_type = 'Subscription Update'")} AS updates,
    {cnt("purchase_type = 'Credits package'")} AS credits,
    {cnt("purchase_type = 'Upsell'")} AS upsells,
    {cnt("purchase_type = 'Reactivation'")} AS react,
    CAST(sum(CAST(amt AS DECIMAL(28,6))) AS DOUBLE) AS s, CAST(sum(CAST(amt AS DECIMAL(28,6))) AS DOUBLE) / count(amt) AS a, max(amt) AS m,
    CAST(sum(CAST(amt AS DECIMAL(28,6))) FILTER (WHERE purchase_type = 'Credits package') AS DOUBLE) AS cs,
    min(us) AS first_us, max(us) AS last_us, count(us) AS n_time
  FROM p GROUP BY user_id)
SELECT a.user_id, a.n AS n_purchases_total,
  CASE WHEN nt > 0 THEN creates END AS n_subscription_creates,
  CASE WHEN nt > 0 THEN updates END AS n_subscription_updates,
  CASE WHEN nt > 0 THEN credits END AS n_credit_package_purchases,
  CASE WHEN nt > 0 THEN upsells END AS n_upsell_purchases,
  CASE WHEN nt > 0 THEN CAST(react > 0 AS BIGINT) END AS has_reactivation_purchase,
  round(CASE WHEN nt > 0 THEN {sdiv('credits', 'a.n')} ELSE CAST(0 AS DOUBLE) END, 6) AS pct_credit_package_purchases,
  round(coalesce(s, CAST(0 AS DOUBLE)), 6) AS total_purchase_dollars,
  round(a.a, 6) AS avg_purchase_dollars, round(m, 6) AS max_purchase_dollars,
  round(CASE WHEN credits > 0 THEN coalesce(cs, CAST(0 AS DOUBLE)) END, 6) AS credit_package_spend_total,
  {fdays(OBS, 'last_us')} AS days_since_last_purchase,
  round(CASE WHEN n_time >= 2 THEN ((last_us - first_us) / {D}.0) / (n_time - 1) END, 6) AS avg_days_between_purchases,
  CAST(CASE WHEN c.up > 0 THEN 1 END AS BIGINT) AS has_plan_upgrade,
  CAST(CASE WHEN c.down > 0 THEN 1 END AS BIGINT) AS has_plan_downgrade,
  CASE WHEN nt > 0 THEN updates END AS n_plan_changes{", first_us AS first_purchase_us" if helpers else ""}
FROM agg a LEFT JOIN chg c ON c.user_id = a.user_id"""


_TXN = f"""
, t AS (SELECT *, failure_code IS NOT NULL AS failed, failure_code IS NULL AS succ,
               epoch_us(transaction_time) AS us, CAST(amount_in_usd AS DOUBLE) AS amt FROM transactions)"""


def transactions_v1() -> str:
    from .sqlkit import b2l
    return view_ctes("transactions", "purchases") + _TXN + f""",
pids AS (SELECT DISTINCT transaction_id FROM purchases WHERE transaction_id IS NOT NULL),
nomatch AS (SELECT t.user_id, count(*) AS n FROM t LEFT JOIN pids ON pids.transaction_id = t.transaction_id
            WHERE t.failed AND pids.transaction_id IS NULL GROUP BY t.user_id),
retry AS (SELECT user_id, count_if(h <= 24) AS r FROM (
            SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id, amt ORDER BY (us IS NULL), us, transaction_id)) / {H}.0 AS h
            FROM t WHERE failed AND amt IS NOT NULL) GROUP BY user_id),
first AS (SELECT user_id, CAST(failed AS BIGINT) AS f FROM (
            SELECT user_id, failed, row_number() OVER (PARTITION BY user_id ORDER BY (us IS NULL), us, transaction_id) AS rn FROM t) WHERE rn = 1),
{mode_cte('mcode', 't', 'user_id', 'failure_code', 'failed')},
{mode_cte('mbill', 't', 'user_id', 'billing_address_country')},
{mode_cte('mfund', 't', 'user_id', 'card_funding')},
{mode_cte('mbrand', 't', 'user_id', 'card_brand')},
agg AS (
  SELECT user_id, count(*) AS n, count_if(succ) AS ns, count_if(failed) AS nf,
    count(DISTINCT amt) FILTER (WHERE failed) AS namts,
    {cnt(f'us >= {OBS} - 30 * {D}')} AS nr, {cnt(f'failed AND us >= {OBS} - 30 * {D}')} AS nrf,
    {cnt("failure_code = 'card_declined'")} AS dec, {cnt("failure_code IN ('incorrect_cvc', 'invalid_cvc')")} AS cvc,
    {cnt("failure_code = 'expired_card'")} AS exp, {cnt("failure_code = 'authentication_required'")} AS auth,
    {cnt("failure_code = 'processing_error'")} AS proc,
    {b2l('bool_or(CAST(is_prepaid AS DOUBLE) <> 0)')} AS uses_prepaid_card,
    {b2l('bool_or(CAST(is_virtual AS DOUBLE) <> 0)')} AS uses_virtual_card,
    {b2l('bool_or(CAST(is_business AS DOUBLE) <> 0)')} AS uses_business_card,
    {b2l("bool_or(digital_wallet <> 'none' AND digital_wallet IS NOT NULL)")} AS uses_digital_wallet,
    {cnt('is_3d_secure = true AND is_3d_secure_authenticated = false')} AS n3ds,
    {cnt('CAST(is_prepaid AS DOUBLE) = 1')} AS npre,
    {cnt("cvc_check = 'fail'")} AS ncf, {cnt("cvc_check = 'unavailable'")} AS n_cvc_unavailable,
    sum(amt) FILTER (WHERE succ) AS ssum, avg(amt) AS aamt, {cnt('succ AND amt > 100')} AS nhv,
    max(us) FILTER (WHERE failed) AS lf, max(us) FILTER (WHERE succ) AS ls
  FROM t GROUP BY user_id)
SELECT a.user_id,
  CASE WHEN nf > 0 THEN CAST(ns = 0 AS BIGINT) END AS has_failed_but_no_successful_payment,
  nm.n AS n_failed_without_matching_purchase,
  fi.f AS first_transaction_was_failure,
  CASE WHEN nf > 0 THEN namts END AS n_distinct_amounts_attempted,
  a.n AS n_total_transaction_attempts, nullif(ns, 0) AS n_successful_transactions, nullif(nf, 0) AS n_failed_transactions,
  round({sdiv('nf', 'a.n')}, 6) AS transaction_failure_rate,
  round(CASE WHEN nr > 0 THEN nrf / nr END, 6) AS transaction_failure_rate_recent,
  round(CASE WHEN nr > 0 THEN nrf / nr END - {sdiv('nf', 'a.n')}, 6) AS failure_rate_acceleration,
  nullif(dec, 0) AS n_card_declined, nullif(cvc, 0) AS n_cvc_failures, nullif(exp, 0) AS n_expired_card,
  nullif(auth, 0) AS n_auth_required_failures, nullif(proc, 0) AS n_processing_errors,
  mcode.mode_value AS dominant_failure_code,
  nullif(r.r, 0) AS payment_retry_count,
  uses_prepaid_card, uses_virtual_card, uses_business_card, uses_digital_wallet,
  mfund.mode_value AS card_funding_type, mbrand.mode_value AS dominant_card_brand,
  mbill.mode_value AS dominant_billing_country,
  round({sdiv('npre', 'a.n')}, 6) AS pct_prepaid_transactions,
  nullif(n3ds, 0) AS n_3d_secure_friction,
  CAST(CASE WHEN ncf > 0 THEN 1 END AS BIGINT) AS has_any_cvc_failure,
  round({sdiv('ncf', 'a.n')}, 6) AS cvc_fail_rate,
  n_cvc_unavailable,
  round(CASE WHEN ns > 0 THEN coalesce(ssum, CAST(0 AS DOUBLE)) END, 6) AS total_transaction_amount_usd,
  round(aamt, 6) AS avg_transaction_amount_usd,
  nullif(nhv, 0) AS n_high_value_transactions,
  {fdays(OBS, 'lf')} AS days_since_last_failed_transaction,
  {fdays(OBS, 'ls')} AS days_since_last_successful_transaction
FROM agg a
LEFT JOIN nomatch nm ON nm.user_id = a.user_id
LEFT JOIN retry r ON r.user_id = a.user_id
LEFT JOIN first fi ON fi.user_id = a.user_id
LEFT JOIN mcode ON mcode.user_id = a.user_id
LEFT JOIN mbill ON mbill.user_id = a.user_id
LEFT JOIN mfund ON mfund.user_id = a.user_id
LEFT JOIN mbrand ON mbrand.user_id = a.user_id"""


def quiz_v1() -> str:
    from .. import config as cfg
    from .sqlkit import b2l, case_map, lit, top_n
    frust = (f"(CASE lower(trim(frustration)) "
             + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in cfg.FRUSTRATION_CANON.items())
             + " ELSE lower(trim(frustration)) END)")
    commercial = ", ".join(lit(x) for x in cfg.COMMERCIAL_USAGE_PLANS)
    depth = " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in cfg.QUIZ_FIELDS)
    return view_ctes("users", "quizzes") + f"""
, q AS (SELECT * FROM quizzes)
SELECT user_id,
  {depth} AS quiz_completion_depth,
  CAST({case_map('lower(trim(source))', cfg.SOURCE_INTENT, '1')} AS BIGINT) AS acquisition_channel_intent,
  {top_n('source', cfg.TOP_SOURCES)} AS source_encoded,
  CAST({case_map('lower(trim(team_size))', cfg.TEAM_SIZE_ORDINAL, '0')} AS BIGINT) AS team_size_ordinal,
  CAST({case_map('lower(trim(experience))', cfg.EXPERIENCE_ORDINAL, '0')} AS BIGINT) AS experience_ordinal,
  {b2l(f'lower(trim(usage_plan)) IN ({commercial})')} AS usage_plan_commercial,
  coalesce(lower(trim(usage_plan)), 'unknown') AS usage_plan_encoded,
  {b2l(f"{frust} = 'high-cost'")} AS frustrated_cost,
  {b2l(f"{frust} = 'inconsistent'")} AS frustrated_quality,
  {b2l(f"{frust} = 'limited'")} AS frustrated_limited,
  {b2l(f"{frust} IN ('confusing', 'hard-prompt')")} AS frustrated_confusing,
  {b2l("contains(lower(first_feature), 'video')")} AS first_feature_video,
  {top_n('first_feature', cfg.TOP_FIRST_FEATURES)} AS first_feature_encoded,
  CAST({case_map('lower(trim(role))', cfg.ROLE_COMMITMENT, '0')} AS BIGINT) AS role_commitment_score,
  coalesce(lower(trim(role)), 'unknown') AS role_encoded
FROM q"""


def transactions_v2() -> str:
    return view_ctes("transactions") + _TXN + f""",
o AS (SELECT user_id, failed, coalesce(sum(CAST(succ AS BIGINT)) OVER (PARTITION BY user_id ORDER BY (us IS NULL), us, transaction_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM t),
streak AS (SELECT user_id, max(c) AS m FROM (SELECT user_id, isl, count(*) AS c FROM o WHERE failed GROUP BY 1, 2) GROUP BY 1),
last AS (SELECT user_id, CAST(failed AS BIGINT) AS f FROM (
  SELECT user_id, failed, row_number() OVER (PARTITION BY user_id ORDER BY (us IS NULL) DESC, us DESC, transaction_id DESC) AS rn FROM t) WHERE rn = 1),
agg AS (SELECT user_id, count_if(succ) AS ns, count_if(failed) AS nf,
   {cnt(f'failed AND us >= {OBS} - 7 * {D}')} AS f7, {cnt(f'failed AND us >= {OBS} - 14 * {D}')} AS f14,
   min(us) FILTER (WHERE failed) AS ff FROM t GROUP BY user_id)
SELECT a.user_id, s.m AS n_consecutive_payment_failures, l.f AS last_transaction_was_failure,
  CAST(CASE WHEN ns > 0 THEN 1 END AS BIGINT) AS has_ever_successfully_paid,
  nullif(f7, 0) AS n_failed_last_7d, nullif(f14, 0) AS n_failed_last_14d,
  {fdays(OBS, 'ff')} AS days_from_first_fail_to_obs,
  round(CASE WHEN nf > 0 THEN {sdiv('f7', 'nf')} END, 6) AS recent_fail_concentration
FROM agg a LEFT JOIN streak s ON s.user_id = a.user_id LEFT JOIN last l ON l.user_id = a.user_id"""


def generations_v2() -> str:
    return view_ctes("users", "properties", "generations") + f"""
, g AS (SELECT user_id, created_at, status, epoch_us(created_at) AS us FROM generations),
d30 AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS d FROM g WHERE us >= {OBS} - 30 * {D}),
gp AS (SELECT user_id, max(gap) AS mg, count(*) AS nd FROM (
         SELECT user_id, datediff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS gap FROM d30) GROUP BY user_id),
agg AS (SELECT user_id, max(us) FILTER (WHERE status = 'completed') AS lc,
   {cnt(f'us >= {OBS} - 14 * {D}')} AS t14, {cnt(f"us >= {OBS} - 14 * {D} AND status = 'completed'")} AS c14,
   {cnt(f'us >= {OBS} - 7 * {D}')} AS l7, count(*) AS tot, max(CAST(created_at AS DATE)) AS last_day
   FROM g GROUP BY user_id),
pr AS (SELECT user_id, {_tenure('epoch_us(subscription_start_date)')} AS ten FROM properties)
SELECT pr.user_id,
  CAST(coalesce(gp.mg, 30) AS BIGINT) AS max_gap_days_last_30,
  CAST(coalesce({clip_lo('30 - gp.nd', 0)}, 30) AS BIGINT) AS zero_gen_days_last_30,
  {fdays(OBS, 'a.lc')} AS days_since_last_completed_gen,
  round(CASE WHEN t14 > 0 THEN c14 / t14 END, 6) AS completion_rate_last14,
  CAST(ten % 30 AS BIGINT) AS plan_renewal_proximity_days,
  round({sdiv('coalesce(a.l7, 0)', '(a.tot / nullif(ten / 7.0, 0)) + 0.1')}, 6) AS gens_last7_pct_of_avg,
  CAST(coalesce({clip_lo(fdays(OBS, 'epoch_us(CAST(a.last_day AS TIMESTAMP))'), 0)}, ten) AS BIGINT) AS trailing_silence_days
FROM pr LEFT JOIN gp ON gp.user_id = pr.user_id LEFT JOIN agg a ON a.user_id = pr.user_id"""


def _rounded_names(sql: str) -> list[str]:
    import re
    return re.findall(r", 6\) AS (\w+)", sql)


def matrix_v1(version: int = 1) -> str:
    from .. import config as cfg
    from ..operators.cross import PAYMENT_RESILIENCE
    from .sqlkit import unround
    parts = {"prop_f": subscription_v1(), "gen_f": generations_v1(), "pur_f": purchases_v1(helpers=True),
             "txn_f": transactions_v1(), "quiz_f": quiz_v1()}
    if version >= 2:
        parts.update({"gen2_f": generations_v2(), "txn2_f": transactions_v2()})
    doubles = ["plan_ordinal", "plan_monthly_credits", "plan_monthly_cost_usd"]
    for v in parts.values():
        doubles += _rounded_names(v)
    sub = ",\n".join(f"{k} AS ({unround(v)})" for k, v in parts.items())
    joins = "\n".join(f"LEFT JOIN {k} ON {k}.user_id = u.user_id" for k in parts)
    stars = ", ".join(f"{k}.* EXCLUDE (user_id{', first_purchase_us' if k == 'pur_f' else ''})" for k in parts)
    inp = "in_props"
    cross = {
        "payment_failure_timing_vs_activity": "days_since_last_failed_transaction - days_since_last_generation",
        "active_during_payment_failure": "CAST(coalesce(abs(days_since_last_generation - days_since_last_failed_transaction) <= 7, false) AS BIGINT)",
        "days_last_purchase_to_last_gen": "days_since_last_purchase - days_since_last_generation",
        "spend_per_generation": "total_purchase_dollars / (total_generations + 1)",
        "plan_credit_utilization_pct": "coalesce(total_credits_consumed / nullif(plan_monthly_credits * greatest(tenure_days / 30.0, 0.5), 0), CAST(0 AS DOUBLE))",
        "plan_credit_surplus_deficit": "plan_monthly_credits * greatest(tenure_days / 30.0, 0.5) - total_credits_consumed",
        "time_to_first_payment_issue_days": clip_lo("tenure_days - days_since_last_failed_transaction", 0),
        "generation_to_purchase_ratio": "total_generations / (n_purchases_total + 1)",
        "is_likely_free_tier_user": "CAST(coalesce(n_purchases_total, 0) = 0 AND coalesce(n_failed_transactions, 0) = 0 AS BIGINT)",
        "generated_before_purchased": f"CAST(coalesce(start_us + days_to_first_generation * {D} < first_purchase_us, false) AS BIGINT)",
        "credit_per_dollar_spent": "total_credits_consumed / (total_purchase_dollars + 1)",
        "n_failed_txns_before_success": "n_failed_without_matching_purchase",
        "billing_country_matches_profile": "CAST(coalesce(trim(upper(dominant_billing_country)) = country, false) AS BIGINT)",
        "feature_expectation_mismatch": "CAST(coalesce(first_feature_video = 1 AND video_generation_ratio < 0.1, false) AS BIGINT)",
    }
    if version >= 2:
        cross["time_to_first_payment_issue_days_min"] = clip_lo("tenure_days - days_from_first_fail_to_obs", 0)
    doubles += ["spend_per_generation", "plan_credit_utilization_pct", "plan_credit_surplus_deficit",
                "generation_to_purchase_ratio", "credit_per_dollar_spent"]
    cross_sql = ", ".join(f"CASE WHEN {inp} THEN {e} END AS {n}" for n, e in cross.items())
    drop_noise = ""
    if version >= 2:
        extras = {"credit_cost_decimal", "inter_gen_regularity", "credit_regularity_score"}
        drop_noise = " EXCLUDE (" + ", ".join(c for c in cfg.NOISE_COLUMNS if c not in extras) + ")"
        doubles = [d for d in doubles if d not in cfg.NOISE_COLUMNS]
    inv = list(PAYMENT_RESILIENCE)
    tot = sum(PAYMENT_RESILIENCE.values())
    eng = ["completion_rate", "active_days_fraction", "gens_first_7_days", "engagement_trajectory_ratio"]
    com = ["team_size_ordinal", "experience_ordinal", "usage_plan_commercial", "role_commitment_score"]
    mm = ", ".join([f"min(CAST({c} AS DOUBLE)) AS mn_{c}, max(CAST({c} AS DOUBLE)) AS mx_{c}" for c in inv + eng]
                   + [f"min(CAST(coalesce({c}, 0) AS DOUBLE)) AS mn_{c}, max(CAST(coalesce({c}, 0) AS DOUBLE)) AS mx_{c}" for c in com])

    def nrm(c, fill=False):
        v = f"CAST(coalesce({c}, 0) AS DOUBLE)" if fill else f"CAST({c} AS DOUBLE)"
        return f"(({v} - mn_{c}) / (mx_{c} - mn_{c} + 1e-9))"
    pr = " + ".join(f"{nrm(c)} * {PAYMENT_RESILIENCE[c] / tot!r}" for c in inv)
    eh_s = " + ".join(f"coalesce({nrm(c)}, 0)" for c in eng)
    eh_k = " + ".join(f"CAST({nrm(c)} IS NOT NULL AS INTEGER)" for c in eng)
    cs = "(" + " + ".join(nrm(c, True) for c in com) + f") / {len(com)}"
    rfm_src = {"rfm_recency_bin": "-CAST(coalesce(days_since_last_generation, 0) AS DOUBLE)",
               "rfm_frequency_bin": "CAST(coalesce(generation_frequency_daily, 0) AS DOUBLE)",
               "rfm_monetary_bin": "CAST(coalesce(total_purchase_dollars, 0) AS DOUBLE)"}
    qsel = ", ".join(f"quantile_cont({e}, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q_{n}" for n, e in rfm_src.items())

    def rfm(n, e):
        q = f"q_{n}"
        interior = f"list_distinct(list_filter([{q}[2], {q}[3], {q}[4]], lambda x: x > {q}[1] AND x < {q}[5]))"
        nb = f"(len({interior}) + CASE WHEN {q}[5] > {q}[1] THEN 1 ELSE 0 END)"
        return f"CASE WHEN {nb} > 0 THEN CAST(len(list_filter({interior}, lambda x: x < {e})) + 1 AS DOUBLE) END AS {n}"
    rfm_sql = ", ".join(rfm(n, e) for n, e in rfm_src.items())
    cats = [c for c in cfg.CATEGORICAL_COLUMNS if not (version >= 2 and c in cfg.NOISE_COLUMNS)]
    enc = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1 AS BIGINT) AS {c}_int" for c in cats)
    doubles += ["payment_resilience_score", "engagement_health_score", "commitment_score",
                "rfm_recency_bin", "rfm_frequency_bin", "rfm_monetary_bin"]
    # money by a small count often ends in a half at the seventh place: rounded as a decimal, half up, as in Spark
    rep = ", ".join(f"CAST(round(CAST({d} AS DECIMAL(38, 12)), 6) AS DOUBLE) AS {d}" if d == "spend_per_generation" else f"round({d}, 6) AS {d}"
                    for d in dict.fromkeys(doubles))
    return view_ctes("users", "properties") + f""",
{sub},
base AS (
  SELECT u.user_id, {stars}, pur_f.first_purchase_us,
         pr.user_id IS NOT NULL AS in_props, epoch_us(pr.subscription_start_date) AS start_us,
         trim(upper(pr.country_code)) AS country
  FROM (SELECT DISTINCT user_id FROM users) u
  {joins}
  LEFT JOIN properties pr ON pr.user_id = u.user_id),
crossed AS (SELECT * EXCLUDE (first_purchase_us, in_props, start_us, country), {cross_sql} FROM base),
feat AS (SELECT *{drop_noise} FROM crossed),
mm AS (SELECT {mm} FROM feat),
qq AS (SELECT {qsel} FROM feat),
comp AS (
  SELECT feat.*, {pr} AS payment_resilience_score,
         CASE WHEN ({eh_k}) > 0 THEN ({eh_s}) / ({eh_k}) END AS engagement_health_score,
         {cs} AS commitment_score, {rfm_sql}
  FROM feat CROSS JOIN mm CROSS JOIN qq),
coded AS (SELECT comp.*, {enc} FROM comp)
SELECT * REPLACE ({rep}) FROM coded"""


def matrix_v2() -> str:
    return matrix_v1(version=2)


def synthetic_signal() -> str:
    from .sqlkit import unround
    return f"""WITH gen AS ({unround(generations_v1())})
SELECT user_id,
  round(CAST(gens_last_7_days - gens_first_7_days AS DOUBLE) / CAST(generation_span_days + 1 AS DOUBLE), 6) AS engagement_velocity,
  round(((avg_credit_cost_per_gen % 1.0) + 1.0) % 1.0, 6) AS credit_cost_decimal,
  CAST(coalesce(((avg_credit_cost_per_gen % 1.0) + 1.0) % 1.0 = 0.0, false) AS DOUBLE) AS credit_regularity_score,
  CAST(coalesce(abs(((avg_inter_generation_hours % 1.0) + 1.0) % 1.0) < 0.05, false) AS DOUBLE) AS inter_gen_regularity
FROM gen"""


def at_risk_leaderboard() -> str:
    from .sqlkit import unround
    return view_ctes("users") + f""",
gen AS ({unround(generations_v1())}),
txn AS ({unround(transactions_v1())}),
pur AS ({unround(purchases_v1())}),
x AS (SELECT u.user_id, gen.total_generations, gen.days_since_last_generation, gen.failure_rate_overall,
        gen.engagement_slope, txn.has_failed_but_no_successful_payment, txn.n_failed_transactions,
        txn.transaction_failure_rate, pur.n_purchases_total,
        CAST(coalesce(pur.n_purchases_total, 0) = 0 AND coalesce(txn.n_failed_transactions, 0) = 0 AS BIGINT) AS is_likely_free_tier_user
      FROM users u LEFT JOIN gen ON gen.user_id = u.user_id LEFT JOIN txn ON txn.user_id = u.user_id
      LEFT JOIN pur ON pur.user_id = u.user_id)
SELECT user_id, total_generations, days_since_last_generation, round(failure_rate_overall, 6) AS failure_rate_overall,
  round(engagement_slope, 6) AS engagement_slope, has_failed_but_no_successful_payment, n_failed_transactions,
  round(transaction_failure_rate, 6) AS transaction_failure_rate, n_purchases_total, is_likely_free_tier_user,
  CASE WHEN has_failed_but_no_successful_payment = 1 AND is_likely_free_tier_user = 0 THEN 'invol_churn'
       WHEN is_likely_free_tier_user = 1 THEN 'not_churned' END AS final_label
FROM x"""


def predict_two_stage() -> str:
    from .o_explain import PROBA
    from .sqlkit import unround
    return view_ctes("users", "contributions") + """
, yu AS (SELECT user_id, 0 AS y FROM users)""" + PROBA + f""",
txn AS ({unround(transactions_v1())}),
pur AS ({unround(purchases_v1())}),
x AS (SELECT u.user_id, txn.has_failed_but_no_successful_payment, txn.n_failed_transactions, pur.n_purchases_total,
        pr.p1 + pr.p2 AS p_churn, pr.p2 / (pr.p1 + pr.p2) AS p_invol,
        CAST(coalesce(pur.n_purchases_total, 0) = 0 AND coalesce(txn.n_failed_transactions, 0) = 0 AS BIGINT) AS free
      FROM users u LEFT JOIN txn ON txn.user_id = u.user_id LEFT JOIN pur ON pur.user_id = u.user_id
      LEFT JOIN pr ON pr.user_id = u.user_id),
g AS (SELECT *, CASE WHEN has_failed_but_no_successful_payment = 1 AND free = 0 THEN 'invol_churn'
                     WHEN free = 1 THEN 'not_churned' END AS final_label FROM x)
SELECT user_id, final_label, round(p_churn, 6) AS p_churn, round(p_invol, 6) AS p_invol,
  coalesce(final_label, CASE WHEN p_churn < 0.30 THEN 'not_churned' WHEN p_churn >= 0.30 THEN
           CASE WHEN p_invol >= 0.5 THEN 'invol_churn' ELSE 'vol_churn' END END) AS predicted_status
FROM g"""


def feature_lists() -> str:
    return view_ctes("users", "contributions") + """
, imp AS (SELECT feature, avg(m) AS mean_abs FROM (SELECT class, feature, avg(abs(contribution)) AS m FROM contributions GROUP BY 1, 2) GROUP BY 1),
rk AS (SELECT feature, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM imp),
ls AS (SELECT * FROM (VALUES ('all', NULL), ('top25', 25), ('top50', 50), ('top75', 75), ('top100', 100)) AS t(list, k))
SELECT list, rank, feature FROM rk CROSS JOIN ls WHERE k IS NULL OR rank <= k"""


def describe_v2_features() -> str:
    from .sqlkit import unround
    cols = ["max_gap_days_last_30", "zero_gen_days_last_30", "days_since_last_completed_gen",
            "completion_rate_last14", "plan_renewal_proximity_days", "gens_last7_pct_of_avg", "trailing_silence_days"]
    body = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min,
  round(max(CAST({c} AS DOUBLE)), 6) AS max FROM v2""" for c in cols)
    return f"WITH v2 AS ({unround(generations_v2())})\n{body}"


def evaluate_predictions() -> str:
    return view_ctes("users") + f""",
p AS ({predict_two_stage()}),
x AS (SELECT CASE u.churn_status WHEN 'not_churned' THEN 0 WHEN 'vol_churn' THEN 1 WHEN 'invol_churn' THEN 2 END AS y,
        CASE p.predicted_status WHEN 'not_churned' THEN 0 WHEN 'vol_churn' THEN 1 WHEN 'invol_churn' THEN 2 END AS pred
      FROM p JOIN users u ON u.user_id = p.user_id),
cm AS (SELECT y, pred, count(*) AS n FROM x GROUP BY 1, 2),
cls AS (SELECT y AS c FROM cm UNION SELECT pred FROM cm),
rep AS (SELECT c, CAST(coalesce((SELECT sum(n) FROM cm WHERE y IS NOT DISTINCT FROM c), 0) AS BIGINT) AS sup,
               CAST(coalesce((SELECT sum(n) FROM cm WHERE pred IS NOT DISTINCT FROM c), 0) AS BIGINT) AS prd,
               CAST(coalesce((SELECT sum(n) FROM cm WHERE y = c AND pred = c), 0) AS BIGINT) AS tp FROM cls)
SELECT CAST(c AS INTEGER) AS cls, sup AS support, prd AS predicted, tp,
  round(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END, 6) AS precision,
  round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall,
  round(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END, 6) AS f1
FROM rep"""


MORE = {"predict_two_stage": predict_two_stage, "evaluate_predictions": evaluate_predictions, "feature_lists": feature_lists,
        "describe_v2_features": describe_v2_features}
