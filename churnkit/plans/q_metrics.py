"""Registered metric / threshold / blend queries over the ``scores`` fixture.

``scores`` has a three-class label ``y`` and two scores: ``s1`` acts as
P(churn) and ``s2`` as P(invol | churn).  A second probability set swaps
their roles, so blend searches have two models to combine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_doubles
from ..operators import metrics as M
from ..sources.fixtures import load_logical
from ..session import configure, stored


def _scores(spark, sf_dir):
    configure(spark)
    s = load_logical(spark, sf_dir)["scores"]
    return s.select("doc_id", F.col("y").cast("int").alias("y"), "s1", "s2",
                    (F.col("y") > 0).cast("int").alias("y_bin"),
                    (F.col("y") == 2).cast("int").alias("y_invol"))


def q_pr_curve(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return round_doubles(M.pr_curve(s, "y_bin", "s1").drop("_dr"))


def q_two_stage_metrics(spark, sf_dir):
    """V1: AP of both stages, best-F1 threshold, 3-class scores of the cascade."""
    s = _scores(spark, sf_dir)
    curve = stored(M.pr_curve(s, "y_bin", "s1"), "pr-curve")  # read for its area and for its best threshold
    ap1 = M.ap_of_curve(curve).withColumnRenamed("average_precision", "pr_auc_s1")
    ap2 = (M.average_precision(s.where(F.col("y_bin") == 1), "y_invol", "s2")
           .withColumnRenamed("average_precision", "pr_auc_s2"))
    best = M.best_f1_of_curve(curve).select(F.col("threshold").alias("best_threshold_s1"), F.col("f1").alias("best_f1_s1"))
    x = s.crossJoin(F.broadcast(best))  # one-row side
    x = x.withColumn("pred_s1", (F.col("s1") >= F.col("best_threshold_s1")).cast("int"))
    x = x.withColumn("pred3", M.cascade_pred(F.col("s1"), F.col("s2"), F.col("best_threshold_s1"), F.lit(0.5)))
    acc1 = x.agg(F.avg((F.col("pred_s1") == F.col("y_bin")).cast("double")).alias("accuracy_s1"))
    f1 = M.summary_f1(x, "y", "pred3").select(F.col("accuracy").alias("accuracy_3class"),
                                               F.col("macro_f1").alias("macro_f1_3class"),
                                               F.col("weighted_f1").alias("weighted_f1_3class"))
    out = ap1.crossJoin(ap2).crossJoin(best).crossJoin(acc1).crossJoin(f1)
    return round_doubles(out)


def _proba(s, a, b, prefix=""):
    return [c.alias(prefix + c._jc.toString().split(" AS ")[-1].strip("`")) for c in
            M.hierarchical_to_3class(F.col(a), F.col(b))]


def _with_two_models(s):
    m1 = M.hierarchical_to_3class(F.col("s1"), F.col("s2"))
    m2 = M.hierarchical_to_3class(F.col("s2"), F.col("s1"))
    return s.select("doc_id", "y", *[c.alias(f"a_p{i}") for i, c in enumerate(m1)],
                    *[c.alias(f"b_p{i}") for i, c in enumerate(m2)])


def q_multiclass_metrics(spark, sf_dir):
    """V2 + V3: argmax decision, accuracy, F1 family, one-vs-rest AP, log loss."""
    s = _with_two_models(_scores(spark, sf_dir))
    p = ["a_p0", "a_p1", "a_p2"]
    x = s.withColumn("pred", M.argmax3(*[F.col(c) for c in p]))
    f1 = M.summary_f1(x, "y", "pred")
    long = x.select("y", F.explode(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(c).alias("score"))
                                            for i, c in enumerate(p)])).alias("_e"))
    long = long.select(F.col("_e.cls").alias("cls"), F.col("_e.score").alias("score"),
                       (F.col("y") == F.col("_e.cls")).cast("int").alias("hit"))
    ap = M.average_precision(long, "hit", "score", keys=["cls"])
    apw = ap.agg(*[F.max(F.when(F.col("cls") == i, F.col("average_precision"))).alias(f"pr_auc_{i}")
                   for i in range(3)], F.avg("average_precision").alias("pr_auc_macro"))
    ll = M.log_loss(x, "y", p)
    return round_doubles(f1.crossJoin(apw).crossJoin(ll))


def q_class_report(spark, sf_dir):
    """Per-class precision, recall, F1 and support of the cascade at (.5, .5)."""
    s = _scores(spark, sf_dir)
    x = s.withColumn("pred", M.cascade_pred(F.col("s1"), F.col("s2"), F.lit(0.5), F.lit(0.5)))
    return round_doubles(M.class_report(x, "y", "pred"))


def q_joint_threshold(spark, sf_dir):
    """40 x 40 grid over both cascade thresholds."""
    s = _scores(spark, sf_dir)
    return round_doubles(M.joint_threshold_search(s, "y", "s1", "s2"))


QUERIES = {
    "pr_curve_s1": q_pr_curve,
    "two_stage_metrics": q_two_stage_metrics,
    "multiclass_metrics": q_multiclass_metrics,
    "class_report": q_class_report,
    "joint_threshold_search": q_joint_threshold,
}


def q_blend_weight_search(spark, sf_dir):
    """Convex weight grid (step .05) maximising macro F1 of the argmax."""
    from ..operators.blend import weight_grid_search
    s = _with_two_models(_scores(spark, sf_dir))
    return round_doubles(weight_grid_search(s, "y", [["a_p0", "a_p1", "a_p2"], ["b_p0", "b_p1", "b_p2"]]))


def q_blend_fixed(spark, sf_dir):
    """B2 + B6 (equal and fixed .7/.3 variants): F1 family of each blend."""
    from ..operators.blend import blend
    s = _with_two_models(_scores(spark, sf_dir))
    ms = [["a_p0", "a_p1", "a_p2"], ["b_p0", "b_p1", "b_p2"]]
    outs = []
    for name, w in [("equal", [1.0, 1.0]), ("fixed_70_30", [0.7, 0.3])]:
        b = s.select("y", *blend(ms, w))
        b = b.withColumn("pred", M.argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
        outs.append(M.summary_f1(b, "y", "pred").crossJoin(M.log_loss(b, "y", ["p0", "p1", "p2"]))
                    .withColumn("variant", F.lit(name)))
    return round_doubles(outs[0].unionByName(outs[1]))


def q_blend_weight_search3(spark, sf_dir):
    """B3 with three models: 171 weight triples."""
    from ..operators.blend import weight_grid_search
    s = _scores(spark, sf_dir)
    m3 = M.hierarchical_to_3class((F.col("s1") + F.col("s2")) / 2, F.col("s2"))
    models = {"a": M.hierarchical_to_3class(F.col("s1"), F.col("s2")), "b": M.hierarchical_to_3class(F.col("s2"), F.col("s1")), "c": m3}
    x = s.select("y", *[c.alias(f"{n}_p{i}") for n, m in models.items() for i, c in enumerate(m)])
    return round_doubles(weight_grid_search(x, "y", [[f"{n}_p{i}" for i in range(3)] for n in "abc"]))


def q_blend_optimal(spark, sf_dir):
    """B6, optimal variant: F1 family and log loss under the best weights of the grid."""
    from ..operators.blend import optimal_blend
    s = _with_two_models(_scores(spark, sf_dir))
    b = optimal_blend(s, "y", [["a_p0", "a_p1", "a_p2"], ["b_p0", "b_p1", "b_p2"]])
    b = b.withColumn("pred", M.argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
    return round_doubles(M.summary_f1(b, "y", "pred").crossJoin(M.log_loss(b, "y", ["p0", "p1", "p2"])))


def q_blend_alpha(spark, sf_dir):
    """Alpha minimising the log loss of alpha*A + (1 - alpha)*B (grid + refinement)."""
    from ..operators.blend import alpha_search
    s = _with_two_models(_scores(spark, sf_dir))
    return round_doubles(alpha_search(s, "y", ["a_p0", "a_p1", "a_p2"], ["b_p0", "b_p1", "b_p2"]))


def q_blend_em(spark, sf_dir):
    """Simplex weights minimising log loss (EM; iterative, no SQL oracle)."""
    from ..operators.blend import em_simplex_weights
    s = _with_two_models(_scores(spark, sf_dir))
    w = em_simplex_weights(s, "y", [["a_p0", "a_p1", "a_p2"], ["b_p0", "b_p1", "b_p2"]])
    return spark.createDataFrame([(f"model_{i}", v) for i, v in enumerate(w)], "model string, weight double")


def q_fixed_cascade(spark, sf_dir):
    """V4: cascade scored with the binary-optimal and the jointly optimal thresholds."""
    s = _scores(spark, sf_dir)
    best = M.best_f1_threshold(s, "y_bin", "s1").select(F.col("threshold").alias("binary_thr_s1"))
    jt = M.joint_threshold_search(s, "y", "s1", "s2").select(F.col("thr_s1").alias("joint_thr_s1"),
                                                             F.col("thr_s2").alias("joint_thr_s2"))
    x = s.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(jt))  # one-row sides
    x = (x.withColumn("pred_bin", M.cascade_pred(F.col("s1"), F.col("s2"), F.col("binary_thr_s1"), F.lit(0.5)))
          .withColumn("pred_joint", M.cascade_pred(F.col("s1"), F.col("s2"), F.col("joint_thr_s1"),
                                                   F.col("joint_thr_s2"))))
    fb = M.summary_f1(x, "y", "pred_bin").select(
        F.col("accuracy").alias("accuracy_binary_thr"), F.col("macro_f1").alias("macro_f1_binary_thr"),
        F.col("weighted_f1").alias("weighted_f1_binary_thr"))
    fj = M.summary_f1(x, "y", "pred_joint").select(
        F.col("accuracy").alias("accuracy_joint_thr"), F.col("macro_f1").alias("macro_f1_joint_thr"),
        F.col("weighted_f1").alias("weighted_f1_joint_thr"), F.col("f1_0").alias("f1_not_churned_joint"),
        F.col("f1_1").alias("f1_vol_churn_joint"), F.col("f1_2").alias("f1_invol_churn_joint"))
    return round_doubles(best.crossJoin(jt).crossJoin(fb).crossJoin(fj))


QUERIES.update({
    "blend_weight_search": q_blend_weight_search,
    "blend_weight_search3": q_blend_weight_search3,
    "blend_optimal": q_blend_optimal,
    "blend_fixed_weights": q_blend_fixed,
    "blend_alpha_logloss": q_blend_alpha,
    "blend_em_weights": q_blend_em,
    "fixed_cascade_metrics": q_fixed_cascade,
})
