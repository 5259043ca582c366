"""DuckDB oracles for the metric queries (global windows, plain SQL)."""

from __future__ import annotations

from ..operators.metrics import threshold_grid
from ..sources.fixtures import view_ctes

SC = view_ctes("scores") + """
, s AS (SELECT doc_id, CAST(y AS INTEGER) AS y, s1, s2, CAST(y > 0 AS INTEGER) AS y_bin,
               CAST(y = 2 AS INTEGER) AS y_invol FROM scores)"""


def curve_ctes(name: str, src: str, label: str, score: str) -> str:
    """CTEs ``{name}`` = per distinct threshold: t, tp (step), ctp, cfp, P."""
    return f""",
{name}_per AS (SELECT {score} AS t, CAST(sum({label}) AS BIGINT) AS tp, CAST(sum(1 - {label}) AS BIGINT) AS fp FROM {src} GROUP BY 1),
{name} AS (SELECT t, tp,
   CAST(sum(tp) OVER (ORDER BY t DESC) AS BIGINT) AS ctp, CAST(sum(fp) OVER (ORDER BY t DESC) AS BIGINT) AS cfp,
   CAST(sum(tp) OVER () AS BIGINT) AS P FROM {name}_per)"""


def f1_ctes(name: str, src: str, y: str, pred: str) -> str:
    """CTE ``{name}`` with accuracy, macro_f1, weighted_f1, f1_0..f1_2 (one row)."""
    return f""",
{name}_cm AS (SELECT {y} AS y, {pred} AS pred, count(*) AS n FROM {src} GROUP BY 1, 2),
{name}_cls AS (SELECT y AS c FROM {name}_cm UNION SELECT pred FROM {name}_cm),
{name}_rep AS (SELECT c,
   coalesce((SELECT sum(n) FROM {name}_cm WHERE y = c), 0) AS sup,
   coalesce((SELECT sum(n) FROM {name}_cm WHERE pred = c), 0) AS prd,
   coalesce((SELECT sum(n) FROM {name}_cm WHERE y = c AND pred = c), 0) AS tp FROM {name}_cls),
{name} AS (SELECT sum(tp) / sum(sup) AS accuracy,
   avg(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END) AS macro_f1,
   sum(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END * sup) / sum(sup) AS weighted_f1,
   coalesce(max(CASE WHEN c = 0 THEN CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END END), 0) AS f1_0,
   coalesce(max(CASE WHEN c = 1 THEN CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END END), 0) AS f1_1,
   coalesce(max(CASE WHEN c = 2 THEN CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END END), 0) AS f1_2
   FROM {name}_rep)"""


def pr_curve_s1() -> str:
    return SC + curve_ctes("c", "s", "y_bin", "s1") + """
SELECT round(t, 6) AS threshold, ctp AS tp, cfp AS fp,
  round(CASE WHEN ctp + cfp > 0 THEN ctp / (ctp + cfp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN P > 0 THEN ctp / P ELSE 1 END, 6) AS recall FROM c"""


def two_stage_metrics() -> str:
    return (SC + curve_ctes("c1", "s", "y_bin", "s1")
            + curve_ctes("c2", "(SELECT * FROM s WHERE y_bin = 1)", "y_invol", "s2") + """,
ap1 AS (SELECT sum(CAST(tp AS DOUBLE) / P * (ctp / (ctp + cfp))) AS pr_auc_s1 FROM c1),
ap2 AS (SELECT sum(CAST(tp AS DOUBLE) / P * (ctp / (ctp + cfp))) AS pr_auc_s2 FROM c2),
f AS (SELECT t, 2 * pr * rc / (pr + rc + 1e-9) AS f1 FROM (
        SELECT t, CASE WHEN ctp + cfp > 0 THEN ctp / (ctp + cfp) ELSE 0 END AS pr,
               CASE WHEN P > 0 THEN ctp / P ELSE 1 END AS rc FROM c1)),
best AS (SELECT t AS best_threshold_s1, f1 AS best_f1_s1 FROM f ORDER BY f1 DESC, t ASC LIMIT 1),
x AS (SELECT s.*, CAST(s1 >= best_threshold_s1 AS INTEGER) AS pred_s1,
        CASE WHEN s1 >= best_threshold_s1 THEN CASE WHEN s2 >= 0.5 THEN 2 ELSE 1 END ELSE 0 END AS pred3
      FROM s CROSS JOIN best),
acc1 AS (SELECT avg(CAST(pred_s1 = y_bin AS DOUBLE)) AS accuracy_s1 FROM x)""" + f1_ctes("m", "x", "y", "pred3") + """
SELECT round(pr_auc_s1, 6) AS pr_auc_s1, round(pr_auc_s2, 6) AS pr_auc_s2,
  round(best_threshold_s1, 6) AS best_threshold_s1, round(best_f1_s1, 6) AS best_f1_s1,
  round(accuracy_s1, 6) AS accuracy_s1, round(m.accuracy, 6) AS accuracy_3class,
  round(m.macro_f1, 6) AS macro_f1_3class, round(m.weighted_f1, 6) AS weighted_f1_3class
FROM ap1, ap2, best, acc1, m""")


def _models() -> str:
    return """,
mm AS (SELECT doc_id, y, 1 - s1 AS a_p0, s1 * (1 - s2) AS a_p1, s1 * s2 AS a_p2,
              1 - s2 AS b_p0, s2 * (1 - s1) AS b_p1, s2 * s1 AS b_p2 FROM s)"""


def multiclass_metrics() -> str:
    eps = "2.220446049250313e-16"
    curves = "".join(curve_ctes(f"k{i}", f"(SELECT CAST(y = {i} AS INTEGER) AS hit, a_p{i} AS sc FROM mm)", "hit", "sc")
                     for i in range(3))
    aps = ", ".join(f"(SELECT sum(CAST(tp AS DOUBLE) / P * (ctp / (ctp + cfp))) FROM k{i}) AS ap{i}" for i in range(3))
    return SC + _models() + """,
x AS (SELECT mm.*, CASE WHEN a_p0 >= a_p1 AND a_p0 >= a_p2 THEN 0 WHEN a_p1 >= a_p2 THEN 1 ELSE 2 END AS pred FROM mm)""" \
        + f1_ctes("m", "x", "y", "pred") + curves + f""",
ap AS (SELECT {aps}),
ll AS (SELECT avg(-ln(least(greatest(CASE y WHEN 0 THEN a_p0 WHEN 1 THEN a_p1 ELSE a_p2 END, {eps}), 1 - {eps}))) AS logloss FROM x)
SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
  round(f1_0, 6) AS f1_0, round(f1_1, 6) AS f1_1, round(f1_2, 6) AS f1_2,
  round(ap0, 6) AS pr_auc_0, round(ap1, 6) AS pr_auc_1, round(ap2, 6) AS pr_auc_2,
  round((ap0 + ap1 + ap2) / 3, 6) AS pr_auc_macro, round(logloss, 6) AS logloss
FROM m, ap, ll"""


def class_report() -> str:
    return SC + """,
x AS (SELECT y, CASE WHEN s1 >= 0.5 THEN CASE WHEN s2 >= 0.5 THEN 2 ELSE 1 END ELSE 0 END AS pred FROM s),
cm AS (SELECT y, pred, count(*) AS n FROM x GROUP BY 1, 2),
cls AS (SELECT y AS c FROM cm UNION SELECT pred FROM cm),
rep AS (SELECT c, CAST(coalesce((SELECT sum(n) FROM cm WHERE y = c), 0) AS BIGINT) AS sup,
               CAST(coalesce((SELECT sum(n) FROM cm WHERE pred = c), 0) AS BIGINT) AS prd,
               CAST(coalesce((SELECT sum(n) FROM cm WHERE y = c AND pred = c), 0) AS BIGINT) AS tp FROM cls)
SELECT c AS cls, sup AS support, prd AS predicted, tp,
  round(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END, 6) AS precision,
  round(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END, 6) AS recall,
  round(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END, 6) AS f1
FROM rep"""


def joint_threshold_search() -> str:
    grid = threshold_grid(40)
    vals = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(grid))
    return SC + f""",
g AS (SELECT * FROM (VALUES {vals}) AS v(k, thr)),
pairs AS (SELECT a.k AS k1, a.thr AS t1, b.k AS k2, b.thr AS t2 FROM g a CROSS JOIN g b),
x AS (SELECT k1, k2, t1, t2, y, CASE WHEN s1 >= t1 THEN CASE WHEN s2 >= t2 THEN 2 ELSE 1 END ELSE 0 END AS pred FROM s CROSS JOIN pairs),
cm AS (SELECT k1, k2, y, pred, count(*) AS n FROM x GROUP BY ALL),
sup AS (SELECT k1, k2, y AS c, sum(n) AS sup FROM cm GROUP BY ALL),
prd AS (SELECT k1, k2, pred AS c, sum(n) AS prd FROM cm GROUP BY ALL),
tp AS (SELECT k1, k2, y AS c, sum(n) AS tp FROM cm WHERE y = pred GROUP BY ALL),
rep AS (SELECT coalesce(sup.k1, prd.k1) AS k1, coalesce(sup.k2, prd.k2) AS k2, coalesce(sup.c, prd.c) AS c,
          coalesce(sup.sup, 0) AS sup, coalesce(prd.prd, 0) AS prd FROM sup FULL JOIN prd ON sup.k1 = prd.k1 AND sup.k2 = prd.k2 AND sup.c = prd.c),
per AS (SELECT rep.k1, rep.k2, avg(CASE WHEN sup + prd > 0 THEN 2 * coalesce(tp.tp, 0) / (sup + prd) ELSE 0 END) AS macro_f1
        FROM rep LEFT JOIN tp ON tp.k1 = rep.k1 AND tp.k2 = rep.k2 AND tp.c = rep.c GROUP BY 1, 2)
SELECT round(g1.thr, 6) AS thr_s1, round(g2.thr, 6) AS thr_s2, round(macro_f1, 6) AS macro_f1
FROM (SELECT * FROM per ORDER BY macro_f1 DESC, k1, k2 LIMIT 1) b JOIN g g1 ON g1.k = b.k1 JOIN g g2 ON g2.k = b.k2"""


ORACLES = {
    "pr_curve_s1": pr_curve_s1,
    "two_stage_metrics": two_stage_metrics,
    "multiclass_metrics": multiclass_metrics,
    "class_report": class_report,
    "joint_threshold_search": joint_threshold_search,
}


def _weight_search(names: str, models: str) -> str:
    """CTEs up to ``best`` (macro_f1 and the weights) over the rows of ``mm`` for models named by letters."""
    from ..operators.blend import weight_candidates
    n = len(names)
    vals = ", ".join("(" + ", ".join([str(i)] + [f"CAST({v!r} AS DOUBLE)" for v in w]) + ")" for i, w in enumerate(weight_candidates(n)))
    ws = ", ".join(f"w{j}" for j in range(n))
    qs = ", ".join(" + ".join(f"{m}_p{c} * w{j}" for j, m in enumerate(names)) + f" AS q{c}" for c in range(3))
    return SC + models + f""",
c AS (SELECT * FROM (VALUES {vals}) AS v(cand, {ws})),
x AS (SELECT cand, y, {qs} FROM mm CROSS JOIN c),
xp AS (SELECT cand, y, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS pred FROM x),
cm AS (SELECT cand, y, pred, count(*) AS n FROM xp GROUP BY ALL),
sup AS (SELECT cand, y AS k, sum(n) AS sup FROM cm GROUP BY ALL),
prd AS (SELECT cand, pred AS k, sum(n) AS prd FROM cm GROUP BY ALL),
tp AS (SELECT cand, y AS k, sum(n) AS tp FROM cm WHERE y = pred GROUP BY ALL),
rep AS (SELECT coalesce(sup.cand, prd.cand) AS cand, coalesce(sup.k, prd.k) AS k, coalesce(sup.sup, 0) AS sup, coalesce(prd.prd, 0) AS prd
        FROM sup FULL JOIN prd ON sup.cand = prd.cand AND sup.k = prd.k),
per AS (SELECT rep.cand, avg(CASE WHEN sup + prd > 0 THEN 2 * coalesce(tp.tp, 0) / (sup + prd) ELSE 0 END) AS macro_f1
        FROM rep LEFT JOIN tp ON tp.cand = rep.cand AND tp.k = rep.k GROUP BY 1),
best AS (SELECT macro_f1, {ws} FROM (SELECT * FROM per ORDER BY macro_f1 DESC, cand LIMIT 1) b JOIN c ON c.cand = b.cand)"""


def blend_weight_search() -> str:
    return _weight_search("ab", _models()) + "\nSELECT round(macro_f1, 6) AS macro_f1, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM best"


def blend_weight_search3() -> str:
    three = _models().replace("mm AS (", "m2 AS (") + """,
mm AS (SELECT m2.*, 1 - (s1 + s2) / 2 AS c_p0, (s1 + s2) / 2 * (1 - s2) AS c_p1, (s1 + s2) / 2 * s2 AS c_p2
       FROM m2 JOIN (SELECT doc_id, s1, s2 FROM s) USING (doc_id))"""
    return _weight_search("abc", three) + "\nSELECT round(macro_f1, 6) AS macro_f1, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM best"


def blend_optimal() -> str:
    return _weight_search("ab", _models()) + """,
ox AS (SELECT y, a_p0 * (w0 / (w0 + w1)) + b_p0 * (w1 / (w0 + w1)) AS p0, a_p1 * (w0 / (w0 + w1)) + b_p1 * (w1 / (w0 + w1)) AS p1,
       a_p2 * (w0 / (w0 + w1)) + b_p2 * (w1 / (w0 + w1)) AS p2 FROM mm, best),
oxp AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM ox)""" + "," + f1_ctes("om", "oxp", "y", "pred").lstrip(",") + """,
oll AS (SELECT avg(-ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS logloss FROM ox)
SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(f1_0, 6) AS f1_0,
       round(f1_1, 6) AS f1_1, round(f1_2, 6) AS f1_2, round(logloss, 6) AS logloss FROM om, oll"""


def blend_fixed_weights() -> str:
    parts = []
    for name, (wa, wb) in [("equal", (0.5, 0.5)), ("fixed_70_30", (0.7, 0.3))]:
        parts.append(f"""
{name}_x AS (SELECT y, a_p0 * {wa!r} + b_p0 * {wb!r} AS p0, a_p1 * {wa!r} + b_p1 * {wb!r} AS p1, a_p2 * {wa!r} + b_p2 * {wb!r} AS p2 FROM mm),
{name}_xp AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {name}_x)"""
                     + f1_ctes(f"{name}_m", f"{name}_xp", "y", "pred")
                     + f""",
{name}_ll AS (SELECT avg(-ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS logloss FROM {name}_x)""")
    sel = " UNION ALL ".join(
        f"SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, "
        f"round(f1_0, 6) AS f1_0, round(f1_1, 6) AS f1_1, round(f1_2, 6) AS f1_2, round(logloss, 6) AS logloss, "
        f"'{n}' AS variant FROM {n}_m, {n}_ll" for n in ("equal", "fixed_70_30"))
    return SC + _models() + "," + ",".join(p.lstrip(",") for p in parts) + "\n" + sel


def blend_alpha_logloss() -> str:
    eps = "2.220446049250313e-16"

    def ll(alpha_src):
        return f"""(SELECT alpha, avg(-ln(least(greatest(CASE y WHEN 0 THEN alpha * a_p0 + (1 - alpha) * b_p0
                     WHEN 1 THEN alpha * a_p1 + (1 - alpha) * b_p1 ELSE alpha * a_p2 + (1 - alpha) * b_p2 END, {eps}), 1 - {eps}))) AS logloss
            FROM mm CROSS JOIN {alpha_src} GROUP BY alpha)"""
    return SC + _models() + f""",
a1 AS (SELECT CAST(i AS DOUBLE) / 100 AS alpha FROM range(0, 101) t(i)),
b1 AS (SELECT alpha FROM {ll('a1')} ORDER BY logloss, alpha LIMIT 1),
a2 AS (SELECT DISTINCT least(1.0, greatest(0.0, b1.alpha + CAST(j AS DOUBLE) / 10000)) AS alpha FROM b1, range(-100, 101) t(j)),
b2 AS (SELECT * FROM {ll('a2')} ORDER BY logloss, alpha LIMIT 1)
SELECT round(alpha, 6) AS alpha, round(logloss, 6) AS logloss FROM b2"""


def fixed_cascade_metrics() -> str:
    jt = joint_threshold_search()
    ts = two_stage_metrics()
    return SC + f""",
jt AS ({jt}),
ts AS ({ts}),
x AS (SELECT s.*, ts.best_threshold_s1 AS bthr, jt.thr_s1 AS j1, jt.thr_s2 AS j2 FROM s, ts, jt),
xp AS (SELECT *, CASE WHEN s1 >= bthr THEN CASE WHEN s2 >= 0.5 THEN 2 ELSE 1 END ELSE 0 END AS pred_bin,
              CASE WHEN s1 >= j1 THEN CASE WHEN s2 >= j2 THEN 2 ELSE 1 END ELSE 0 END AS pred_joint FROM x)""" \
        + f1_ctes("fb", "xp", "y", "pred_bin") + f1_ctes("fj", "xp", "y", "pred_joint") + """
SELECT ts.best_threshold_s1 AS binary_thr_s1, jt.thr_s1 AS joint_thr_s1, jt.thr_s2 AS joint_thr_s2,
  round(fb.accuracy, 6) AS accuracy_binary_thr, round(fb.macro_f1, 6) AS macro_f1_binary_thr,
  round(fb.weighted_f1, 6) AS weighted_f1_binary_thr,
  round(fj.accuracy, 6) AS accuracy_joint_thr, round(fj.macro_f1, 6) AS macro_f1_joint_thr,
  round(fj.weighted_f1, 6) AS weighted_f1_joint_thr, round(fj.f1_0, 6) AS f1_not_churned_joint,
  round(fj.f1_1, 6) AS f1_vol_churn_joint, round(fj.f1_2, 6) AS f1_invol_churn_joint
FROM ts, jt, fb, fj"""


ORACLES.update({
    "blend_weight_search": blend_weight_search,
    "blend_weight_search3": blend_weight_search3,
    "blend_optimal": blend_optimal,
    "blend_fixed_weights": blend_fixed_weights,
    "blend_alpha_logloss": blend_alpha_logloss,
    "fixed_cascade_metrics": fixed_cascade_metrics,
})
