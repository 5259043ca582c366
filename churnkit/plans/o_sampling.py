"""DuckDB oracles for splits, folds and class weights."""

from __future__ import annotations

from ..sources.fixtures import view_ctes

LAB = view_ctes("users") + """
, lab AS (SELECT user_id, CAST(CASE churn_status WHEN 'not_churned' THEN 0 WHEN 'vol_churn' THEN 1 WHEN 'invol_churn' THEN 2 END AS INTEGER) AS y FROM users),
rk AS (SELECT user_id, y, row_number() OVER (PARTITION BY y ORDER BY CAST(('0x' || substr(md5('42' || CAST(user_id AS VARCHAR)), 1, 15)) AS BIGINT), user_id) AS pos,
              count(*) OVER (PARTITION BY y) AS n FROM lab)"""


def stratified_splits() -> str:
    return LAB + """,
c AS (SELECT *, CAST(round(n * 0.1) AS BIGINT) AS t1 FROM rk),
c2 AS (SELECT *, t1 + CAST(round((n - t1) * (0.1 / (1.0 - 0.1))) AS BIGINT) AS t2 FROM c)
SELECT user_id, y, CASE WHEN pos <= t1 THEN 'test' WHEN pos <= t2 THEN 'val' ELSE 'train' END AS split FROM c2"""


def holdout_split() -> str:
    return LAB + """
SELECT user_id, y, CASE WHEN pos <= CAST(round(n * 0.15) AS BIGINT) THEN 'holdout' ELSE 'trainval' END AS split FROM rk"""


def stratified_folds() -> str:
    return LAB + """
SELECT user_id, y, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM rk"""


def class_weights() -> str:
    return LAB + """
SELECT y, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM lab GROUP BY y"""


def adasyn_allocation() -> str:
    """All distances spelled out; quotas and largest remainders in whole numbers."""
    return """
WITH e AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
d AS (SELECT a.vec_id, b.y AS yb, row_number() OVER (PARTITION BY a.vec_id ORDER BY
        sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), b.vec_id) AS r
      FROM e a JOIN e b ON a.y = 1 AND a.vec_id <> b.vec_id),
c AS (SELECT e.vec_id, count(*) FILTER (d.vec_id IS NOT NULL AND yb IS DISTINCT FROM 1) AS m
      FROM e LEFT JOIN d ON e.vec_id = d.vec_id AND r <= 5 WHERE e.y = 1 GROUP BY e.vec_id),
g AS (SELECT greatest(0, count(*) FILTER (y = 0) - count(*) FILTER (y = 1)) AS n FROM e),
w AS (SELECT vec_id, m, CASE WHEN sum(m) OVER () > 0 THEN m ELSE 1 END AS w FROM c),
q AS (SELECT vec_id, m, (w * n) // CAST(sum(w) OVER () AS BIGINT) AS f, (w * n) % CAST(sum(w) OVER () AS BIGINT) AS rem, n FROM w, g),
k AS (SELECT *, row_number() OVER (ORDER BY rem DESC, vec_id) AS pos, sum(f) OVER () AS given FROM q)
SELECT vec_id, m AS majority_neighbours, CAST(f + CASE WHEN pos <= n - given THEN 1 ELSE 0 END AS BIGINT) AS n_new FROM k"""


ORACLES = {
    "stratified_splits": stratified_splits,
    "holdout_split": holdout_split,
    "stratified_folds": stratified_folds,
    "class_weights": class_weights,
    "adasyn_allocation": adasyn_allocation,
}
