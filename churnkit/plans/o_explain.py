"""DuckDB oracles for the explanation queries."""

from __future__ import annotations

from ..explain_values import DISPLAY_NAMES, INTERVENTIONS
from ..sources.fixtures import view_ctes
from .sqlkit import lit

BASE = view_ctes("users", "contributions") + """
, yu AS (SELECT user_id, CASE churn_status WHEN 'not_churned' THEN 0 WHEN 'vol_churn' THEN 1 WHEN 'invol_churn' THEN 2 END AS y FROM users)"""


def dn(expr: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in DISPLAY_NAMES.items())
    title = (f"array_to_string(list_transform(string_split(replace({expr}, '_', ' '), ' '), "
             f"lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
    return f"(CASE {expr} {whens} ELSE {title} END)"


def _clusters() -> str:
    ct = ", ".join(f"({lit(k)}, {i}, {v[0]}, {lit(v[1])}, {lit(f)})"
                   for i, (k, v) in enumerate(INTERVENTIONS.items()) for f in v[3])
    heads = ", ".join(f"({lit(k)}, {i}, {v[0]}, {lit(v[1])})" for i, (k, v) in enumerate(INTERVENTIONS.items()))
    return f""",
ct AS (SELECT * FROM (VALUES {ct}) AS t(cluster, ord, cls, label, feature)),
heads AS (SELECT * FROM (VALUES {heads}) AS t(cluster, ord, cls, label)),
firsts AS (SELECT cls, min(ord) AS first_ord FROM heads GROUP BY cls)"""


def _reasons(src: str, name: str = "r") -> str:
    return f""",
{name} AS (SELECT user_id, class, rank, feature, {dn('feature')} AS display_name, contribution,
             CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, class ORDER BY abs(contribution) DESC, feature) AS rank FROM {src})
      WHERE rank <= 5)"""


def _interventions(keys: str, reasons: str, name: str = "iv") -> str:
    return f""",
{name}_ov AS (SELECT r.user_id, r.class, ct.ord, count(*) AS overlap FROM {reasons} r JOIN ct ON ct.feature = r.feature AND ct.cls = r.class GROUP BY ALL),
{name}_best AS (SELECT user_id, class, ord, overlap FROM (
   SELECT *, row_number() OVER (PARTITION BY user_id, class ORDER BY overlap DESC, ord) AS rn FROM {name}_ov) WHERE rn = 1),
{name} AS (SELECT k.user_id, k.class, h.cluster, h.label, CAST(coalesce(b.overlap, 0) AS BIGINT) AS overlap
   FROM {keys} k LEFT JOIN {name}_best b ON b.user_id = k.user_id AND b.class = k.class
   LEFT JOIN firsts f ON f.cls = k.class LEFT JOIN heads h ON h.ord = coalesce(b.ord, f.first_ord))"""


PROBA = """,
mg AS (SELECT user_id, coalesce(sum(contribution) FILTER (WHERE class = 0), 0) AS m0,
              coalesce(sum(contribution) FILTER (WHERE class = 1), 0) AS m1,
              coalesce(sum(contribution) FILTER (WHERE class = 2), 0) AS m2 FROM contributions GROUP BY user_id),
ex AS (SELECT user_id, exp(m0 - greatest(m0, m1, m2)) AS e0, exp(m1 - greatest(m0, m1, m2)) AS e1, exp(m2 - greatest(m0, m1, m2)) AS e2 FROM mg),
pr AS (SELECT ex.user_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, yu.y
       FROM ex JOIN yu ON yu.user_id = ex.user_id)"""


def global_importance() -> str:
    return BASE + """
SELECT class, feature, round(avg(abs(contribution)), 6) AS mean_abs,
  row_number() OVER (PARTITION BY class ORDER BY avg(abs(contribution)) DESC, feature) AS rank
FROM contributions GROUP BY class, feature"""


def top_reasons() -> str:
    return BASE + _reasons("contributions") + """
SELECT user_id, class, rank, feature, display_name, round(contribution, 6) AS contribution, direction FROM r"""


def intervention_mapping() -> str:
    return (BASE + _clusters() + _reasons("contributions")
            + _interventions("(SELECT DISTINCT user_id, class FROM r)", "r") + """
SELECT user_id, class, cluster, label, overlap FROM iv""")


def explain_examples() -> str:
    return (BASE + _clusters() + PROBA + """,
exs AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred_class FROM (
   SELECT *, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 1 THEN p1 ELSE p2 END DESC, user_id) AS example_rank
   FROM pr WHERE y IN (1, 2)) WHERE example_rank <= 2),
src AS (SELECT c.* FROM contributions c JOIN exs ON exs.user_id = c.user_id AND exs.pred_class = c.class)"""
            + _reasons("src") + _interventions("(SELECT user_id, pred_class AS class FROM exs)", "r") + """
SELECT exs.user_id, exs.pred_class, exs.y AS true_class, exs.example_rank, round(p0, 6) AS p0, round(p1, 6) AS p1,
  round(p2, 6) AS p2, r.rank, r.feature, r.display_name, round(r.contribution, 6) AS contribution, r.direction,
  iv.label AS intervention
FROM exs LEFT JOIN r ON r.user_id = exs.user_id AND r.class = exs.pred_class
LEFT JOIN iv ON iv.user_id = exs.user_id AND iv.class = exs.pred_class""")


def strategy_summary() -> str:
    return BASE + _clusters() + """,
imp AS (SELECT class, feature, row_number() OVER (PARTITION BY class ORDER BY avg(abs(contribution)) DESC, feature) AS rank
        FROM contributions GROUP BY class, feature),
top AS (SELECT * FROM imp WHERE class IN (1, 2) AND rank <= 10)
SELECT t.class, ct.cluster, ct.label, string_agg(t.feature, ',' ORDER BY t.feature) AS matched_features
FROM top t JOIN ct ON ct.feature = t.feature GROUP BY t.class, ct.cluster, ct.label"""


def risk_histogram() -> str:
    return BASE + PROBA + """,
lg AS (SELECT y AS true_class, 1 AS cls, p1 AS p FROM pr UNION ALL SELECT y, 2, p2 FROM pr),
rg AS (SELECT cls, true_class, min(p) AS mn, max(p) AS mx FROM lg GROUP BY ALL),
x AS (SELECT lg.*, CASE WHEN mx > mn THEN mn ELSE mn - 0.5 END AS lo, CASE WHEN mx > mn THEN mx ELSE mx + 0.5 END AS hi
      FROM lg JOIN rg USING (cls, true_class)),
x1 AS (SELECT *, (hi - lo) / 50.0 AS st, least(CAST(floor((p - lo) / (hi - lo) * 50.0) AS INTEGER), 49) AS i0 FROM x),
x2 AS (SELECT *, CASE WHEN p < CASE WHEN i0 >= 50 THEN hi ELSE i0 * st + lo END THEN i0 - 1 ELSE i0 END AS i1 FROM x1),
x3 AS (SELECT *, CASE WHEN p >= CASE WHEN i1 + 1 >= 50 THEN hi ELSE (i1 + 1) * st + lo END AND i1 <> 49 THEN i1 + 1 ELSE i1 END AS bin FROM x2)
SELECT cls, true_class, bin, count(*) AS n FROM x3 GROUP BY ALL"""


ORACLES = {
    "global_importance": global_importance,
    "top_reasons": top_reasons,
    "intervention_mapping": intervention_mapping,
    "explain_examples": explain_examples,
    "strategy_summary": strategy_summary,
    "risk_histogram": risk_histogram,
}
