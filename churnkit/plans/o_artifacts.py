"""DuckDB oracles for the artifact and Benford queries."""

from __future__ import annotations

from ..sources.fixtures import view_ctes
from .sqlkit import mode_cte


def _bf(v: str) -> str:
    d = f"least(greatest(CAST(floor(abs({v}) / pow(10, floor(log10(abs({v}) + 1e-12)))) AS BIGINT), 1), 9)"
    return f"CASE WHEN {v} > 0 THEN log10(1 + 1.0 / {d}) ELSE 0.0 END"


def _snapped(name: str, src: str, val: str) -> str:
    return f""",
{name}_anch AS (SELECT CAST({val} AS DOUBLE) AS a FROM {src} WHERE {val} IS NOT NULL GROUP BY 1 HAVING count(*) >= 40),
{name}_v AS (SELECT user_id, transaction_id, CAST({val} AS DOUBLE) AS v FROM {src} WHERE user_id IS NOT NULL AND {val} IS NOT NULL),
{name}_lh AS (SELECT x.*, (SELECT max(a) FROM {name}_anch WHERE a < x.v) AS lo, (SELECT min(a) FROM {name}_anch WHERE a >= x.v) AS hi FROM {name}_v x),
{name}_s AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL THEN v WHEN hi IS NULL THEN lo WHEN lo IS NULL THEN hi
                            WHEN abs(v - lo) < abs(v - hi) THEN lo ELSE hi END AS sv FROM {name}_lh),
{name}_f AS (SELECT sv, count(*) / sum(count(*)) OVER () AS freq FROM {name}_s GROUP BY sv),
{name}_r AS (SELECT s.user_id, abs(s.v - s.sv) AS dist, s.v - s.sv AS diff, {_bf('s.v')} AS bf, f.freq,
   abs(s.v) - floor(abs(s.v)) AS frac, floor(abs(s.v)) AS ip FROM {name}_s s JOIN {name}_f f ON f.sv = s.sv),
{name}_d AS (SELECT *, CAST(floor(frac * 10) AS BIGINT) AS d1, CAST(frac < 0.005 AS BIGINT) AS is_round,
   CAST(abs(frac - 0.25) < 0.01 OR abs(frac - 0.50) < 0.01 OR abs(frac - 0.75) < 0.01 AS BIGINT) AS is_quarter,
   CAST(((ip % 10) + 10) % 10 AS BIGINT) AS mod10 FROM {name}_r)"""


def artifact_features() -> str:
    return (view_ctes("users", "transactions", "purchases") + _snapped("t", "transactions", "amount_in_usd")
            + _snapped("p", "purchases", "purchase_amount_dollars") + ",\n"
            + mode_cte("t_m1", "t_d", "user_id", "d1", alias="m") + ",\n"
            + mode_cte("t_m10", "t_d", "user_id", "mod10", alias="m") + ",\n"
            + mode_cte("p_m1", "p_d", "user_id", "d1", alias="m") + """,
ta AS (SELECT user_id, avg(dist) AS txn_mean_snap_dist, max(dist) AS txn_max_snap_dist, avg(diff) AS txn_mean_snap_diff,
   stddev_samp(diff) AS txn_std_snap_diff, avg(bf) AS txn_mean_benford, min(bf) AS txn_min_benford,
   sum(is_round) AS txn_n_round, sum(is_quarter) AS txn_n_quarter, avg(is_round) AS txn_pct_round,
   avg(is_quarter) AS txn_pct_quarter, avg(freq) AS txn_snap_freq_mean FROM t_d GROUP BY user_id),
pa AS (SELECT user_id, avg(dist) AS purch_mean_snap_dist, max(dist) AS purch_max_snap_dist, avg(diff) AS purch_mean_snap_diff,
   avg(bf) AS purch_mean_benford, sum(is_round) AS purch_n_round, avg(is_round) AS purch_pct_round,
   avg(freq) AS purch_snap_freq_mean FROM p_d GROUP BY user_id)
SELECT u.user_id,
  round(coalesce(txn_mean_snap_dist, 0), 6) AS txn_mean_snap_dist, round(coalesce(txn_max_snap_dist, 0), 6) AS txn_max_snap_dist,
  round(coalesce(txn_mean_snap_diff, 0), 6) AS txn_mean_snap_diff, round(coalesce(txn_std_snap_diff, 0), 6) AS txn_std_snap_diff,
  round(coalesce(txn_mean_benford, 0), 6) AS txn_mean_benford, round(coalesce(txn_min_benford, 0), 6) AS txn_min_benford,
  CAST(coalesce(txn_n_round, 0) AS BIGINT) AS txn_n_round, CAST(coalesce(txn_n_quarter, 0) AS BIGINT) AS txn_n_quarter,
  round(coalesce(txn_pct_round, 0), 6) AS txn_pct_round, round(coalesce(txn_pct_quarter, 0), 6) AS txn_pct_quarter,
  round(coalesce(txn_snap_freq_mean, 0), 6) AS txn_snap_freq_mean,
  CAST(coalesce(t_m1.m, 0) AS BIGINT) AS txn_d1_mode, CAST(coalesce(t_m10.m, 0) AS BIGINT) AS txn_mod10_mode,
  round(coalesce(purch_mean_snap_dist, 0), 6) AS purch_mean_snap_dist, round(coalesce(purch_max_snap_dist, 0), 6) AS purch_max_snap_dist,
  round(coalesce(purch_mean_snap_diff, 0), 6) AS purch_mean_snap_diff, round(coalesce(purch_mean_benford, 0), 6) AS purch_mean_benford,
  CAST(coalesce(purch_n_round, 0) AS BIGINT) AS purch_n_round, round(coalesce(purch_pct_round, 0), 6) AS purch_pct_round,
  round(coalesce(purch_snap_freq_mean, 0), 6) AS purch_snap_freq_mean, CAST(coalesce(p_m1.m, 0) AS BIGINT) AS purch_d1_mode
FROM users u LEFT JOIN ta ON ta.user_id = u.user_id LEFT JOIN pa ON pa.user_id = u.user_id
LEFT JOIN t_m1 ON t_m1.user_id = u.user_id LEFT JOIN t_m10 ON t_m10.user_id = u.user_id LEFT JOIN p_m1 ON p_m1.user_id = u.user_id""")


def benford_leading_digits() -> str:
    d = "least(greatest(CAST(floor(abs(v) / pow(10, floor(log10(abs(v) + 1e-12)))) AS BIGINT), 1), 9)"
    return f"""WITH ev AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value > 0),
obs AS (SELECT {d} AS digit, count(*) AS n FROM ev GROUP BY 1),
exp AS (SELECT CAST(i AS BIGINT) AS digit, log10(1 + 1.0 / i) AS expected FROM range(1, 10) t(i))
SELECT exp.digit, CAST(coalesce(obs.n, 0) AS BIGINT) AS n,
  round(coalesce(obs.n / (SELECT sum(n) FROM obs), 0), 6) AS observed, round(expected, 6) AS expected
FROM exp LEFT JOIN obs ON obs.digit = exp.digit"""


ORACLES = {"artifact_features": artifact_features, "benford_leading_digits": benford_leading_digits}
