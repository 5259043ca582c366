"""DuckDB oracles for the profiling queries."""

from __future__ import annotations

from ..sources.fixtures import view_ctes

N_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
          "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


def profile_shape() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST({n} AS BIGINT) AS n_cols FROM {t}"
                              for t, n in N_COLS.items())


#: columns of the fixture views
VIEW_COLUMNS = {
    "users": ["user_id", "churn_status"],
    "properties": ["user_id", "subscription_start_date", "subscription_plan", "country_code"],
    "generations": ["user_id", "generation_id", "created_at", "completed_at", "status", "credit_cost", "generation_type", "resolution",
                    "aspect_ration", "duration"],
    "purchases": ["user_id", "transaction_id", "purchase_time", "purchase_type", "purchase_amount_dollars"],
    "transactions": ["user_id", "transaction_id", "transaction_time", "amount_in_usd", "failure_code", "is_prepaid", "is_virtual",
                     "is_business", "cvc_check", "billing_address_country", "card_country", "card_brand", "card_funding",
                     "digital_wallet", "card_3d_secure_support", "is_3d_secure", "is_3d_secure_authenticated"],
    "quizzes": ["user_id", "source", "flow_type", "team_size", "experience", "usage_plan", "frustration", "first_feature", "role"],
    "scores": ["doc_id", "y", "s1", "s2"],
    "contributions": ["user_id", "class", "feature", "contribution"],
}


def profile_missing() -> str:
    return view_ctes(*VIEW_COLUMNS) + "\nSELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count_if({c} IS NULL) AS missing FROM {t}"
        for t, cols in VIEW_COLUMNS.items() for c in cols) + ") WHERE missing > 0"


def profile_describe_numeric() -> str:
    from .q_profile import NUMBERS
    parts = []
    for t, cols in NUMBERS.items():
        for c in cols:
            v = f"CAST({c} AS DOUBLE)"
            parts.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
  round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(quantile_cont({v}, 0.25), 6) AS p25,
  round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75 FROM {t}""")
    return " UNION ALL ".join(parts)


def profile_describe_categorical() -> str:
    from .q_profile import TEXT_COLUMNS
    parts = []
    for t, cols in TEXT_COLUMNS.items():
        for c in cols:
            parts.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", sum(n) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(parts)


def profile_top_values() -> str:
    from .q_profile import TOP_TABLES
    # timestamps are written as Spark writes them
    text = lambda c: f"regexp_replace(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', '')" if c.endswith(("_time", "_date", "_at")) else f"CAST({c} AS VARCHAR)"
    lg = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, {text(c)} AS value FROM {t}" for t in TOP_TABLES for c in VIEW_COLUMNS[t])
    return view_ctes(*TOP_TABLES) + f""",
lg AS ({lg}),
vc AS (SELECT tab, col, value, count(*) AS count FROM lg GROUP BY 1, 2, 3),
card AS (SELECT tab, col, count(*) AS card FROM vc WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT vc.* FROM vc LEFT JOIN card USING (tab, col) WHERE NOT (coalesce(card.card, 0) > 50 AND contains(lower(col), 'id')))
SELECT tab AS "table", col AS "column", value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY count DESC, value ASC NULLS FIRST) AS rank FROM f) WHERE rank <= 10
UNION ALL SELECT tab, col, 'skipped', card, NULL FROM card WHERE card > 50 AND contains(lower(col), 'id')"""


def profile_class_share() -> str:
    return view_ctes("users") + """
SELECT churn_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM users WHERE churn_status IS NOT NULL GROUP BY 1"""


def profile_counts_by() -> str:
    return "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"


def profile_mean_by() -> str:
    return view_ctes("generations") + """
SELECT generation_type, round(avg(duration), 6) AS mean FROM generations GROUP BY 1"""


def profile_bridge_matrix() -> str:
    return view_ctes("users", "properties", "quizzes", "transactions", "purchases") + """,
br AS (SELECT DISTINCT transaction_id, user_id FROM purchases),
mp AS (SELECT t.transaction_id, t.failure_code, t.amount_in_usd, br.user_id FROM transactions t JOIN br ON br.transaction_id = t.transaction_id),
ag AS (SELECT user_id, count(transaction_id) AS total_attempts, count(failure_code) AS total_failed,
          CAST(coalesce(sum(amount_in_usd), 0) AS DOUBLE) AS amount_attempted FROM mp GROUP BY 1)
SELECT u.user_id, u.churn_status, p.subscription_plan, p.country_code, q.experience, q.team_size,
  coalesce(ag.total_attempts, 0) AS total_attempts, coalesce(ag.total_failed, 0) AS total_failed,
  round(coalesce(ag.amount_attempted, 0), 6) AS amount_attempted,
  round(coalesce(ag.total_failed / CASE WHEN ag.total_attempts = 0 THEN 1 ELSE ag.total_attempts END, 0), 6) AS failure_rate
FROM users u LEFT JOIN properties p ON p.user_id = u.user_id LEFT JOIN quizzes q ON q.user_id = u.user_id
LEFT JOIN ag ON ag.user_id = u.user_id"""


ORACLES = {
    "profile_shape": profile_shape,
    "profile_missing": profile_missing,
    "profile_describe_numeric": profile_describe_numeric,
    "profile_describe_categorical": profile_describe_categorical,
    "profile_top_values": profile_top_values,
    "profile_class_share": profile_class_share,
    "profile_counts_by": profile_counts_by,
    "profile_mean_by": profile_mean_by,
    "profile_bridge_matrix": profile_bridge_matrix,
}
