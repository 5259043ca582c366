"""Metrics, thresholds and probability combination (section 2.17).

Every metric is a DataFrame computation; nothing is collected to build it.

* PR curve / average precision: counts per *distinct* score (partial
  aggregation), then cumulative counts over descending scores.  The
  cumulative sums come from :func:`ordered.ordered` over a constant key, so
  the distinct-score table is ranked in bounded chunks rather than in one
  global-window task.  AP = sum over distinct thresholds of
  (recall step) x precision, the step-wise (not trapezoidal) definition.
* classification metrics: a <= 9-cell confusion table from one
  ``groupBy(y, pred)``; accuracy, per-class / macro / weighted F1 with
  zero-division 0, over the labels present in truth or prediction.
* joint threshold grid: each row is binned once against the 40 grid
  values of both scores; a ``(y, bin1, bin2)`` count table (at most
  3 x 41 x 41 rows whatever the data size) is crossed with the 1,600 grid
  pairs, so the search cost does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import ordered

EPS = float(np.finfo(np.float64).eps)


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


# ----------------------------------------------------------------- PR curve / AP
def pr_curve(df: DataFrame, label: str, score: str, keys=None, chunk_rows: int | None = None) -> DataFrame:
    """One row per (keys, distinct score): tp/fp at ``score >= threshold``,
    precision, recall, and the recall step of that threshold."""
    ks = _keys(keys)
    grp = ks if ks else []
    d = df.select(*grp, F.col(score).cast("double").alias("threshold"),
                  (F.col(label) == 1).cast("long").alias("_pos"))
    per = d.groupBy(*grp, "threshold").agg(F.sum("_pos").alias("_tp"),
                                            F.sum(1 - F.col("_pos")).alias("_fp"))
    if not grp:
        per = per.withColumn("_k", F.lit(0))
        grp2 = ["_k"]
    else:
        grp2 = grp
    per = stored(per, "pr-scores")
    # totals per key reach the rows through the chunk summary, not by a join on the key
    tot = per.groupBy(*grp2).agg(F.sum("_tp").alias("_totp"), F.sum("_fp").alias("_totn"))
    o = ordered(per, grp2, "threshold", "threshold",
                sums_before={"tp": F.col("_tp"), "fp": F.col("_fp")}, chunk_rows=chunk_rows, stats=tot)
    tp = F.col("_totp") - F.col("before_tp")
    fp = F.col("_totn") - F.col("before_fp")
    out = o.select(*grp2, "threshold", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                   F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
                   F.when(F.col("_totp") > 0, tp / F.col("_totp")).otherwise(F.lit(1.0)).alias("recall"),
                   F.when(F.col("_totp") > 0, F.col("_tp") / F.col("_totp")).alias("_dr"))
    return out.drop("_k") if not ks else out


def average_precision(df: DataFrame, label: str, score: str, keys=None, **kw) -> DataFrame:
    ks = _keys(keys)
    return ap_of_curve(pr_curve(df, label, score, ks or None, **kw), ks)


def ap_of_curve(curve: DataFrame, keys=None) -> DataFrame:
    """Average precision of a :func:`pr_curve`."""
    return curve.groupBy(*_keys(keys)).agg(F.sum(F.col("_dr") * F.col("precision")).alias("average_precision"))


def best_f1_threshold(df: DataFrame, label: str, score: str, keys=None, **kw) -> DataFrame:
    """Threshold maximising 2PR/(P+R+1e-9); lowest threshold on ties."""
    ks = _keys(keys)
    return best_f1_of_curve(pr_curve(df, label, score, ks or None, **kw), ks)


def best_f1_of_curve(c: DataFrame, keys=None) -> DataFrame:
    """:func:`best_f1_threshold` of a :func:`pr_curve`."""
    ks = _keys(keys)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-9))
    c = c.withColumn("f1", f1)
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt")))
    return c.groupBy(*ks).agg(best.alias("_b")).select(
        *ks, (-F.col("_b.nt")).alias("threshold"), F.col("_b.f1").alias("f1"))


# ----------------------------------------------------------- classification metrics
def confusion(df: DataFrame, y: str, pred: str, keys=None) -> DataFrame:
    ks = _keys(keys)
    return df.groupBy(*ks, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, pred: str, keys=None) -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1 (zero-division 0)."""
    ks = _keys(keys)
    cm = confusion(df, y, pred, ks)
    truth = cm.groupBy(*ks, F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    predd = cm.groupBy(*ks, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("y") == F.col("pred")).groupBy(*ks, F.col("y").alias("cls")).agg(F.sum("n").alias("tp"))
    r = (truth.join(predd, ks + ["cls"], "full").join(tp, ks + ["cls"], "left")
         .fillna(0, subset=["support", "predicted", "tp"]))
    tpc, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return r.select(*ks, "cls", sup.cast("long").alias("support"), prd.cast("long").alias("predicted"),
                    tpc.cast("long").alias("tp"),
                    F.when(prd > 0, tpc / prd).otherwise(F.lit(0.0)).alias("precision"),
                    F.when(sup > 0, tpc / sup).otherwise(F.lit(0.0)).alias("recall"),
                    F.when(sup + prd > 0, 2 * tpc / (sup + prd)).otherwise(F.lit(0.0)).alias("f1"))


def summary_f1(df: DataFrame, y: str, pred: str, keys=None, classes=(0, 1, 2)) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 and f1_<class> in one row per key."""
    ks = _keys(keys)
    rep = class_report(df, y, pred, ks)
    aggs = [
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    ]
    aggs += [F.coalesce(F.max(F.when(F.col("cls") == c, F.col("f1"))), F.lit(0.0)).alias(f"f1_{c}")
             for c in classes]
    return rep.groupBy(*ks).agg(*aggs)


def macro_f1_of_counts(cm: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, macro_f1`` of confusion counts ``keys, y, pred, n``: the mean F1 of the classes in ``y`` or ``pred``."""
    as_class = F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"), F.lit(0).cast("long").alias("tp")),
                                 F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                                          F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))))
    per = cm.select(*keys, as_class.alias("_c")).groupBy(*keys, "_c.c").agg(*[F.sum(f"_c.{v}").alias(v) for v in ("sup", "prd", "tp")])
    f1 = F.when(F.col("sup") + F.col("prd") > 0, 2 * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(0.0)
    return per.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Argmax of three probabilities, first class on ties."""
    return (F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)).cast("int")


def cascade_pred(s1: Column, s2: Column, thr1, thr2) -> Column:
    """Two-stage decision: not churned below thr1, else invol if s2 >= thr2."""
    return F.when(s1 >= thr1, F.when(s2 >= thr2, 2).otherwise(1)).otherwise(0).cast("int")


def hierarchical_to_3class(p_churn: Column, p_invol: Column) -> list[Column]:
    """B1: (1 - pc, pc (1 - pi), pc pi)."""
    return [(1 - p_churn).alias("p0"), (p_churn * (1 - p_invol)).alias("p1"),
            (p_churn * p_invol).alias("p2")]


def log_loss(df: DataFrame, y: str, probs: list[str], keys=None) -> DataFrame:
    """V9: mean -ln(clip(p_y, eps, 1 - eps)) (clip only, as the pinned learner library)."""
    ks = _keys(keys)
    py = F.element_at(F.array(*[F.col(p) for p in probs]), F.col(y).cast("int") + 1)
    clipped = F.least(F.greatest(py, F.lit(EPS)), F.lit(1 - EPS))
    return df.groupBy(*ks).agg(F.avg(-F.ln(clipped)).alias("logloss"))


# ------------------------------------------------------------- joint threshold grid
def threshold_grid(steps: int = 40, lo: float = 0.10, hi: float = 0.90) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, steps)]


def joint_threshold_search(df: DataFrame, y3: str, s1: str, s2: str, steps: int = 40) -> DataFrame:
    """(thr1, thr2) on a steps x steps grid maximising 3-class macro F1;
    the first maximum in (thr1, thr2) order wins."""
    grid = threshold_grid(steps)
    g = F.array(*[F.lit(x) for x in grid])
    cells = (df.select(F.col(y3).cast("int").alias("y"),
                       F.size(F.filter(g, lambda t: F.col(s1) >= t)).alias("b1"),
                       F.size(F.filter(g, lambda t: F.col(s2) >= t)).alias("b2"))
               .groupBy("y", "b1", "b2").agg(F.count(F.lit(1)).alias("n")))
    spark = df.sparkSession
    pairs = spark.range(steps * steps).select((F.col("id") / steps).cast("int").alias("k1"),
                                              (F.col("id") % steps).cast("int").alias("k2"))
    # bounded sides: cells <= 3*(steps+1)^2 rows, pairs = steps^2 rows
    x = F.broadcast(cells).crossJoin(pairs)
    pred = F.when(F.col("b1") > F.col("k1"), F.when(F.col("b2") > F.col("k2"), 2).otherwise(1)).otherwise(0)
    x = x.select("k1", "k2", "y", pred.alias("pred"), "n")
    cm = x.groupBy("k1", "k2", "y", "pred").agg(F.sum("n").alias("n"))
    truth = cm.groupBy("k1", "k2", F.col("y").alias("cls")).agg(F.sum("n").alias("sup"))
    prd = cm.groupBy("k1", "k2", F.col("pred").alias("cls")).agg(F.sum("n").alias("prd"))
    tp = cm.where(F.col("y") == F.col("pred")).groupBy("k1", "k2", F.col("y").alias("cls")).agg(F.sum("n").alias("tp"))
    rep = (truth.join(prd, ["k1", "k2", "cls"], "full").join(tp, ["k1", "k2", "cls"], "left")
           .fillna(0, subset=["sup", "prd", "tp"]))
    f1 = F.when(F.col("sup") + F.col("prd") > 0, 2 * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(0.0)
    per = rep.groupBy("k1", "k2").agg(F.avg(f1).alias("macro_f1"))
    best = per.agg(F.max(F.struct(F.col("macro_f1"), (-F.col("k1")).alias("n1"), (-F.col("k2")).alias("n2")))
                   .alias("b"))
    gm = F.create_map(*[x for i, v in enumerate(grid) for x in (F.lit(i), F.lit(v))])
    return best.select(F.element_at(gm, -F.col("b.n1")).alias("thr_s1"),
                       F.element_at(gm, -F.col("b.n2")).alias("thr_s2"),
                       F.col("b.macro_f1").alias("macro_f1"))
