"""Model recipes on ``pyspark.ml`` (section 2.16).

The third-party boosters of the original are re-aimed at MLlib learners:
``GBTClassifier`` (binary; early stopping through ``validationIndicatorCol``),
``RandomForestClassifier``, ``LogisticRegression`` (elastic net, multinomial)
and ``MultilayerPerceptronClassifier``.  Cross-validation never relies on row
order: folds come from :func:`operators.sampling.assign_folds` (hash rank
within class) and out-of-fold (OOF) predictions are keyed by ``user_id``.

MLlib rejects NULL/NaN features, so every recipe imputes first (median or
0).  Fitting is distributed by MLlib itself; the driver only loops over
folds, candidates and seeds (a handful of small jobs each).
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import argmax3
from ..session import stored

KEY = "user_id"


def feature_columns(df: DataFrame, exclude=(KEY, "y", "y_churn", "y_invol", "fold", "split")) -> list[str]:
    """Numeric columns only, in frame order."""
    num = ("integer", "long", "double", "float", "short")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in num and f.name not in exclude]


def prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """NULL -> 0 and cast to double (the FE path's final fill; MLlib needs no NULLs)."""
    return df.select(*[c for c in df.columns if c not in features],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def learner(kind: str, label: str, params: dict | None = None, weight: str | None = None, seed: int = 42):
    """Recipe learners."""
    p = dict(params or {})
    if kind == "gbt":
        est = GBTClassifier(labelCol=label, featuresCol="features", seed=seed,
                            maxIter=p.pop("maxIter", 20), maxDepth=p.pop("maxDepth", 4), **p)
    elif kind == "rf":
        est = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed,
                                     numTrees=p.pop("numTrees", 50), maxDepth=p.pop("maxDepth", 8),
                                     minInstancesPerNode=p.pop("minInstancesPerNode", 5), **p)
    elif kind == "lr":
        est = LogisticRegression(labelCol=label, featuresCol="features",
                                 elasticNetParam=p.pop("elasticNetParam", 0.5), regParam=p.pop("regParam", 0.01),
                                 family=p.pop("family", "auto"), maxIter=p.pop("maxIter", 100), **p)
    elif kind == "mlp":
        est = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", seed=seed,
                                             layers=p.pop("layers"), maxIter=p.pop("maxIter", 100), **p)
    else:
        raise ValueError(kind)
    if weight and kind in ("gbt", "rf", "lr"):
        est.setWeightCol(weight)
    return est


def pipeline(features: list[str], est, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="features_raw" if scale else "features",
                              handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages + [est])


def _p1(pred: DataFrame, out: str) -> DataFrame:
    return pred.select(KEY, vector_to_array("probability")[1].alias(out))


def _add_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced class weights (M4) as a column."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = c.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(tot)).select(label, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("_w"))
    return train.join(F.broadcast(w), label)


def resample(train: DataFrame, label: str, features: list[str], sampler: str | None) -> DataFrame:
    """Training rows with a weight ``_w``: all 1 (None), balanced by class ("class_weight"), or
    1 with synthetic minority rows added ("smote": the smaller class up to the larger;
    "smote_enn": rows whose neighbours disagree removed after that; "adasyn": more rows where
    the neighbours are of the other class)."""
    if sampler is None:
        return train.withColumn("_w", F.lit(1.0))
    if sampler == "class_weight":
        return _add_weights(train, label)
    from ..operators.sampling import adasyn, enn_clean, smote
    if sampler == "adasyn":
        out = adasyn(train.select(KEY, label, *features), label, features, KEY).drop("synthetic")
        return out.withColumn("_w", F.lit(1.0))
    out = smote(train.select(KEY, label, *features), label, features, KEY).drop("synthetic")
    if sampler == "smote_enn":
        out = enn_clean(out, label, features, KEY)
    elif sampler != "smote":
        raise ValueError(sampler)
    return out.withColumn("_w", F.lit(1.0))


def two_stage_cv(df: DataFrame, features: list[str], s1: str = "gbt", s2: str = "gbt", k: int = 5,
                 min_churn: int = 10, params1=None, params2=None, sampler: str | None = "class_weight") -> DataFrame:
    """OOF P(churn) from stage 1 on all rows, OOF P(invol | churn) from stage 2
    on churned rows (0 elsewhere); stage 2 skipped when <= ``min_churn`` churned
    training rows.  ``sampler`` (see :func:`resample`) works on the training rows of a
    fold only.  Needs ``y``, ``fold``."""
    d = prepare(df, features).withColumn("y_churn", (F.col("y") > 0).cast("double")) \
        .withColumn("y_invol", (F.col("y") == 2).cast("double"))
    parts = []
    for f in range(k):
        rest = d.where(F.col("fold") != f)
        va = d.where(F.col("fold") == f)
        m1 = pipeline(features, learner(s1, "y_churn", params1, "_w")).fit(resample(rest, "y_churn", features, sampler))
        o1 = _p1(m1.transform(va), "oof_s1")
        ctr = rest.where(F.col("y_churn") == 1)
        cva = va.where(F.col("y_churn") == 1)
        if ctr.count() > min_churn and cva.limit(1).count() > 0:
            m2 = pipeline(features, learner(s2, "y_invol", params2, "_w")).fit(resample(ctr, "y_invol", features, sampler))
            o2 = _p1(m2.transform(cva), "oof_s2")
            o1 = o1.join(o2, KEY, "left")
        else:
            o1 = o1.withColumn("oof_s2", F.lit(None).cast("double"))
        parts.append(o1)
    oof = reduce(lambda a, b: a.unionByName(b), parts)
    return d.select(KEY, "y", "fold").join(oof, KEY).fillna(0.0, subset=["oof_s2"])


def multiclass_cv(df: DataFrame, features: list[str], kind: str = "rf", k: int = 5, params=None,
                  scale: bool = False, seed: int = 42) -> DataFrame:
    """3-class OOF probabilities ``p0, p1, p2`` keyed by user.

    Training rows carry balanced class weights, except for the network, whose
    learner takes none."""
    d = prepare(df, features).withColumn("y_d", F.col("y").cast("double"))
    parts = []
    for f in range(k):
        tr = _add_weights(d.where(F.col("fold") != f), "y_d")
        va = d.where(F.col("fold") == f)
        est = learner(kind, "y_d", params, None if kind == "mlp" else "_w", seed)
        m = pipeline(features, est, scale).fit(tr)
        pr = m.transform(va).select(KEY, vector_to_array("probability").alias("_p"))
        parts.append(pr.select(KEY, *[F.col("_p")[i].alias(f"p{i}") for i in range(3)]))
    oof = reduce(lambda a, b: a.unionByName(b), parts)
    return d.select(KEY, "y", "fold").join(oof, KEY)


def ovr_specialists(df: DataFrame, features: list[str], k: int = 5, params=None) -> DataFrame:
    """One binary GBT per class with Platt scaling (a one-feature logistic
    regression fitted on inner out-of-fold scores), stacked and row-normalised."""
    d = prepare(df, features)
    outs = []
    for c in range(3):
        dc = d.withColumn("yb", (F.col("y") == c).cast("double"))
        parts = []
        for f in range(k):
            tr, va = dc.where(F.col("fold") != f), dc.where(F.col("fold") == f)
            # inner split for calibration: the next fold id inside the training part
            inner = (f + 1) % k
            base_tr, cal = tr.where(F.col("fold") != inner), tr.where(F.col("fold") == inner)
            m = pipeline(features, learner("gbt", "yb", params)).fit(base_tr)
            cal_s = m.transform(cal).select("yb", vector_to_array("probability")[1].alias("s"))
            platt = Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="features"),
                                     LogisticRegression(labelCol="yb", featuresCol="features", regParam=0.0)]).fit(cal_s)
            va_s = m.transform(va).select(KEY, vector_to_array("probability")[1].alias("s"))
            parts.append(platt.transform(va_s).select(KEY, vector_to_array("probability")[1].alias(f"q{c}")))
        outs.append(reduce(lambda a, b: a.unionByName(b), parts))
    q = reduce(lambda a, b: a.join(b, KEY), outs)
    s = F.greatest(F.col("q0") + F.col("q1") + F.col("q2"), F.lit(1e-9))
    return d.select(KEY, "y", "fold").join(q, KEY).select(
        KEY, "y", "fold", *[(F.col(f"q{c}") / s).alias(f"p{c}") for c in range(3)])


def stack(level1: list[DataFrame], names: list[str], k: int = 5) -> DataFrame:
    """Meta logistic regression on the wide table of level-1 OOF columns
    (itself cross-validated on the same folds)."""
    wide = level1[0].select(KEY, "y", "fold", *[F.col(f"p{i}").alias(f"{names[0]}_p{i}") for i in range(3)])
    for df, n in zip(level1[1:], names[1:]):
        wide = wide.join(df.select(KEY, *[F.col(f"p{i}").alias(f"{n}_p{i}") for i in range(3)]), KEY)
    meta_cols = [f"{n}_p{i}" for n in names for i in range(3)]
    # stored once: every pass of every fold's fit would score all level-1 models and join them again
    wide = stored(wide, "stack-wide")
    return multiclass_cv(wide, meta_cols, kind="lr", k=k, params={"family": "multinomial", "elasticNetParam": 0.0})


def seed_average(runs: list[DataFrame]) -> DataFrame:
    """Mean probability per user over runs on the same folds."""
    u = reduce(lambda a, b: a.unionByName(b), runs)
    return u.groupBy(KEY, "y", "fold").agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(3)])


def soft_vote(frames: list[DataFrame], weights: list[float], col: str = "oof_s2") -> DataFrame:
    """T4: weighted average of one probability column of several models."""
    tot = float(sum(weights))
    j = reduce(lambda a, b: a.join(b, KEY), [f.select(KEY, F.col(col).alias(f"_v{i}")) for i, f in enumerate(frames)])
    return j.select(KEY, reduce(lambda a, b: a + b, [F.col(f"_v{i}") * (w / tot) for i, w in enumerate(weights)])
                    .alias(col))


def random_search(df: DataFrame, features: list[str], space: dict, n_trials: int = 4, k: int = 3,
                  kind: str = "rf", seed: int = 42) -> DataFrame:
    """Seeded random search; objective = CV macro F1 of the argmax.  Returns
    one row per trial (the leaderboard), best first."""
    from ..operators.metrics import summary_f1
    rng = random.Random(seed)
    rows = []
    d = df.withColumn("fold", F.pmod(F.col("fold"), F.lit(k)))
    for t in range(n_trials):
        params = {name: rng.choice(vals) for name, vals in space.items()}
        oof = multiclass_cv(d, features, kind, k, dict(params))
        pred = oof.withColumn("pred", argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
        m = summary_f1(pred, "y", "pred").first()
        rows.append((t, json.dumps(params, sort_keys=True), float(m["macro_f1"]), float(m["weighted_f1"])))
    res = df.sparkSession.createDataFrame(rows, "trial int, params string, macro_f1 double, weighted_f1 double")
    return res.orderBy(F.col("macro_f1").desc(), "trial")


def final_fit(df: DataFrame, features: list[str], kind: str, params: dict, path: str | None = None,
              meta: dict | None = None) -> PipelineModel:
    """Fit on all rows with chosen params; persist with Spark ML persistence
    and a JSON sidecar of the metadata."""
    d = prepare(df, features).withColumn("y_d", F.col("y").cast("double"))
    model = pipeline(features, learner(kind, "y_d", dict(params))).fit(d)
    if path:
        model.write().overwrite().save(path)
        side = {"features": features, "kind": kind, "params": params, **(meta or {})}
        df.sparkSession.createDataFrame([(json.dumps(side),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(path + "_meta")
    return model


def linear_contributions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """X1 (linear models): per user, class and feature, ``coef * (x - mean)``
    as a long table ``(user_id, class, feature, contribution)``."""
    lr = model.stages[-1]
    coef = lr.coefficientMatrix.toArray() if hasattr(lr, "coefficientMatrix") else None
    d = prepare(df, features)
    means = d.agg(*[F.avg(c).alias(c) for c in features]).first()
    rows = []
    for cls in range(coef.shape[0]):
        for j, c in enumerate(features):
            rows.append((cls, c, float(coef[cls, j]), float(means[c] or 0.0)))
    tbl = df.sparkSession.createDataFrame(rows, "class int, feature string, coef double, mean double")
    st = F.stack(F.lit(len(features)), *[x for c in features for x in (F.lit(c), F.col(c))]).alias("feature", "x")
    long = d.select(KEY, st)
    return long.join(F.broadcast(tbl), "feature").select(  # coefficient table: classes x features
        KEY, "class", "feature", (F.col("coef") * (F.col("x") - F.col("mean"))).alias("contribution"))


@dataclass
class Recipe:
    """One named pipeline of the catalogue."""
    name: str
    features: str = "all"            # name of a column list handed to run_recipe
    sampler: str | None = "class_weight"  # of the two-stage recipes, see resample
    stage1: str = "gbt"
    stage2: str = "gbt"
    multiclass: str | None = None    # a 3-class learner, or "ovr", "stack", "seed_avg"
    blend: list = field(default_factory=list)   # names of recipes whose probabilities are averaged
    threshold_rule: str = "argmax"   # or "best_f1" (stage 1), "joint" (both stages)
    depends_on: list = field(default_factory=list)


CATALOGUE = [
    Recipe("A", sampler=None), Recipe("B", stage1="lr"), Recipe("C"), Recipe("D", sampler="smote"),
    Recipe("E", threshold_rule="best_f1"), Recipe("N", sampler=None, threshold_rule="joint"),
    Recipe("K", multiclass="rf"), Recipe("L", multiclass="lr"), Recipe("M", multiclass="mlp"),
    Recipe("P03", blend=["A", "K", "L"], depends_on=["A", "K", "L"]),
    Recipe("P04", multiclass="stack", depends_on=["K", "L"]),
    Recipe("P08", features="core", multiclass="rf"), Recipe("P09", multiclass="seed_avg"), Recipe("P12", multiclass="ovr"),
    # T7 simplified suite: forest of 300 trees, depth 15, 25 rows in a leaf
    Recipe("S_rf", multiclass="rf_big"),
]


def run_recipe(recipe: Recipe, df: DataFrame, features: list[str], k: int = 3, done: dict[str, DataFrame] | None = None,
               feature_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """Runs one recipe; returns OOF probabilities ``(user_id, y, fold, p0, p1, p2)``.

    ``done`` holds results of recipes it depends on (those not in it are run first);
    ``feature_sets`` the column lists besides "all"."""
    from ..operators.metrics import hierarchical_to_3class
    done = dict(done or {})
    for other in CATALOGUE:
        if other.name in recipe.depends_on and other.name not in done:
            done[other.name] = run_recipe(other, df, features, k, done, feature_sets)
    features = features if recipe.features == "all" else (feature_sets or {})[recipe.features]
    if recipe.blend:
        runs = reduce(lambda a, b: a.unionByName(b), [done[n].select(KEY, "y", "fold", "p0", "p1", "p2") for n in recipe.blend])
        return seed_average([runs])
    if recipe.multiclass == "rf_big":
        return multiclass_cv(df, features, "rf", k, {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 25})
    if recipe.multiclass in ("rf", "lr"):
        params = {"family": "multinomial"} if recipe.multiclass == "lr" else None
        return multiclass_cv(df, features, recipe.multiclass, k, params, scale=recipe.multiclass == "lr")
    if recipe.multiclass == "mlp":
        return multiclass_cv(df, features, "mlp", k, {"layers": [len(features), 16, 3]}, scale=True)
    if recipe.multiclass == "ovr":
        return ovr_specialists(df, features, k)
    if recipe.multiclass == "stack":
        return stack([done[n] for n in recipe.depends_on], recipe.depends_on, k)
    if recipe.multiclass == "seed_avg":
        return seed_average([multiclass_cv(df, features, "rf", k, seed=s) for s in (1, 2, 3)])
    oof = two_stage_cv(df, features, recipe.stage1, recipe.stage2, k, sampler=recipe.sampler)
    return oof.select(KEY, "y", "fold", *hierarchical_to_3class(F.col("oof_s1"), F.col("oof_s2")))


def decide(recipe: Recipe, oof: DataFrame) -> DataFrame:
    """Adds ``pred`` by the recipe's rule; thresholds are chosen on the OOF rows."""
    from ..operators.metrics import best_f1_threshold, cascade_pred, joint_threshold_search
    if recipe.threshold_rule == "argmax":
        return oof.withColumn("pred", argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
    churn = F.col("p1") + F.col("p2")
    x = oof.withColumn("_s1", churn).withColumn("_s2", F.coalesce(F.try_divide(F.col("p2"), churn), F.lit(0.0)))
    if recipe.threshold_rule == "best_f1":
        thr1 = best_f1_threshold(x.withColumn("_yc", (F.col("y") > 0).cast("int")), "_yc", "_s1").first()["threshold"]
        thr2 = 0.5
    elif recipe.threshold_rule == "joint":
        best = joint_threshold_search(x, "y", "_s1", "_s2").first()
        thr1, thr2 = best["thr_s1"], best["thr_s2"]
    else:
        raise ValueError(recipe.threshold_rule)
    return x.withColumn("pred", cascade_pred(F.col("_s1"), F.col("_s2"), F.lit(float(thr1)), F.lit(float(thr2)))).drop("_s1", "_s2")


def run_catalogue(df: DataFrame, features: list[str], recipes: list[Recipe] | None = None, k: int = 3,
                  feature_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """The leaderboard of a catalogue, best first: ``recipe, status, macro_f1, weighted_f1``.

    A recipe that fails is a row with its error and does not stop the others; recipes that
    depend on it are skipped.  Each result is stored, so dependants read it."""
    from ..operators.metrics import summary_f1
    done: dict[str, DataFrame] = {}
    rows = []
    for r in recipes or CATALOGUE:
        if any(n not in done for n in r.depends_on):
            rows.append((r.name, "skipped", None, None))
            continue
        try:
            oof = stored(run_recipe(r, df, features, k, done, feature_sets), "recipe")
            m = summary_f1(decide(r, oof), "y", "pred").first()
            done[r.name] = oof
            rows.append((r.name, "ok", float(m["macro_f1"]), float(m["weighted_f1"])))
        except Exception as e:  # one recipe's failure must not lose the others' results
            rows.append((r.name, f"failed: {type(e).__name__}", None, None))
    return df.sparkSession.createDataFrame(rows, "recipe string, status string, macro_f1 double, weighted_f1 double") \
        .orderBy(F.col("macro_f1").desc_nulls_last(), "recipe")


def tree_table(model) -> list[dict]:
    """Parse a fitted GBT or RF model into plain arrays per tree (driver-side,
    bounded by the model size): feature, threshold (or left categories), children,
    cover (training weight) and outputs of each node.

    A boosted tree has one output, its prediction; a forest's tree has one per class,
    the class shares of the node.  Read once from the JVM tree objects."""
    boosted = hasattr(model, "treeWeights") and model.__class__.__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    trees = []
    for t, w in zip(model.trees, weights):
        tree = {k: [] for k in ("feat", "thr", "cats", "left", "right", "cover", "value")}
        todo = [(t._java_obj.rootNode(), -1, None)]
        while todo:
            node, parent, side = todo.pop()
            i = len(tree["feat"])
            stats = node.impurityStats()
            tree["cover"].append(float(stats.count()))
            if boosted:
                tree["value"].append([float(node.prediction())])
            else:
                share = [float(x) for x in stats.stats()]
                tree["value"].append([x / (sum(share) or 1.0) for x in share])
            tree["left"].append(-1)
            tree["right"].append(-1)
            if parent >= 0:
                tree[side][parent] = i
            inner = node.getClass().getSimpleName() == "InternalNode"
            split = node.split() if inner else None
            continuous = inner and split.getClass().getSimpleName() == "ContinuousSplit"
            tree["feat"].append(int(split.featureIndex()) if inner else -1)
            tree["thr"].append(float(split.threshold()) if continuous else float("nan"))
            tree["cats"].append(set(map(float, split.leftCategories())) if inner and not continuous else None)
            if inner:
                todo += [(node.rightChild(), i, "right"), (node.leftChild(), i, "left")]
        trees.append({"w": float(w), **tree})
    return trees


def leaf_paths(tree: dict) -> list[tuple[int, list[tuple[int, list[tuple[int, bool]], float]]]]:
    """(leaf, [(feature, [(node, goes left)], cover share)]) per leaf; a feature that a path
    asks several times is one entry."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = tree["feat"][node]
        if f < 0:
            out.append((node, [(k, conds, z) for k, (conds, z) in path.items()]))
            continue
        for side in ("left", "right"):
            child = tree[side][node]
            conds, z = path.get(f, ([], 1.0))
            share = tree["cover"][child] / (tree["cover"][node] or 1.0)
            todo.append((child, {**path, f: ([*conds, (node, side == "left")], z * share)}))
    return out


def tree_shap(tree: dict, x):
    """Path-dependent Shapley values of one tree for the rows of ``x``: (values n x features x outputs, base).

    A leaf counts with the share of the coalitions that reach it: features outside
    a coalition follow the training cover.  Per leaf with m features the sums over coalitions by
    size are the coefficients of a product of m linear factors, so the work is m**3
    per leaf and vectorised over the rows."""
    import math

    import numpy as np
    n, outs = len(x), len(tree["value"][0])
    left = {}
    for i, f in enumerate(tree["feat"]):
        if f >= 0:
            left[i] = np.isin(x[:, f], list(tree["cats"][i])) if tree["cats"][i] is not None else x[:, f] <= tree["thr"][i]
    phi, base = np.zeros((n, x.shape[1], outs)), np.zeros(outs)
    for leaf, path in leaf_paths(tree):
        value = np.asarray(tree["value"][leaf])
        base += value * math.prod(z for _, _, z in path)
        m = len(path)
        on = [np.logical_and.reduce([left[i] == goes for i, goes in conds]).astype(float) for _, conds, _ in path]
        for j, (f, _, z) in enumerate(path):
            sums = np.zeros((m, n))  # coalitions of the other features, by size
            sums[0] = 1.0
            for k, (_, _, zk) in enumerate(path):
                if k != j:
                    sums[1:] = sums[1:] * zk + sums[:-1] * on[k]
                    sums[0] *= zk
            weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
            phi[:, f, :] += ((on[j] - z) * (weight @ sums))[:, None] * value
    return phi, base


def tree_contributions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """X1 (trees): path-dependent Shapley values per user, class and feature.

    A boosted binary model explains its margin (class 1), a forest the probability
    of every class.  Per row and class: sum of contributions + base = the model's output
    (checked by the ``additivity_error`` column).  The parsed trees are broadcast
    (their size is the model's, not the data's); rows are scored in ``mapInPandas`` batches."""
    import numpy as np
    import pandas as pd
    last = model.stages[-1]
    boosted = last.__class__.__name__.startswith("GBT")
    bc = df.sparkSession.sparkContext.broadcast(tree_table(last))
    d = prepare(df, features)
    output = F.array(vector_to_array("rawPrediction")[1]) if boosted else vector_to_array("probability")
    scored = model.transform(d).select(KEY, *features, output.alias("_out"))
    key_type = dict(d.dtypes)[KEY]
    classes = [1] if boosted else list(range(last.numClasses))

    def attribute(batches):
        for b in batches:
            x = b[features].to_numpy(dtype=float)
            want = np.array(b["_out"].tolist(), dtype=float).reshape(len(b), len(classes))
            phi, base = np.zeros((len(x), len(features), len(classes))), np.zeros(len(classes))
            for tree in bc.value:
                p, e = tree_shap(tree, x)
                phi += tree["w"] * p
                base += tree["w"] * e
            err = np.abs(phi.sum(axis=1) + base - want)
            for k, c in enumerate(classes):
                yield pd.DataFrame({KEY: np.repeat(b[KEY].to_numpy(), len(features)), "class": c,
                                    "feature": np.tile(features, len(x)), "contribution": phi[:, :, k].reshape(-1),
                                    "base": base[k], "additivity_error": np.repeat(err[:, k], len(features))})

    return scored.mapInPandas(attribute, f"{KEY} {key_type}, class int, feature string, contribution double, base double, "
                                         "additivity_error double")


def categorical_cv(df: DataFrame, features: list[str], categoricals: list[str], k: int = 5,
                   kind: str = "rf", params=None, max_bins: int = 64) -> DataFrame:
    """Categorical-aware 3-class CV - NULL -> 'unknown', ``StringIndexer``
    (unseen -> extra index) and trees whose ``maxBins`` cover the largest domain
    (at least ``max_bins``)."""
    from pyspark.ml.feature import StringIndexer
    d = prepare(df, features)
    for c in categoricals:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    sizes = d.agg(*[F.count_distinct(c).alias(c) for c in categoricals]).first()  # one number per column
    max_bins = max([max_bins, *(n + 1 for n in sizes)])
    d = d.withColumn("y_d", F.col("y").cast("double"))
    parts = []
    for f in range(k):
        tr, va = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
        idx = StringIndexer(inputCols=categoricals, outputCols=[f"{c}_idx" for c in categoricals],
                            handleInvalid="keep")
        p = dict(params or {})
        p.setdefault("maxBins", max_bins)
        est = learner(kind, "y_d", p)
        pipe = Pipeline(stages=[idx, VectorAssembler(inputCols=features + [f"{c}_idx" for c in categoricals],
                                                     outputCol="features", handleInvalid="keep"), est])
        pr = pipe.fit(tr).transform(va).select(KEY, vector_to_array("probability").alias("_p"))
        parts.append(pr.select(KEY, *[F.col("_p")[i].alias(f"p{i}") for i in range(3)]))
    return d.select(KEY, "y", "fold").join(reduce(lambda a, b: a.unionByName(b), parts), KEY)


def gbt_early_stopping(train: DataFrame, features: list[str], label: str, valid_fold: int,
                       params: dict | None = None, tol: float = 0.01) -> PipelineModel:
    """Binary GBT with early stopping on one fold's rows
    (``validationIndicatorCol`` + ``validationTol``)."""
    d = prepare(train, features).withColumn("_is_val", F.col("fold") == valid_fold)
    p = dict(params or {})
    est = learner("gbt", label, p)
    est.setValidationIndicatorCol("_is_val")
    est.set(est.getParam("validationTol"), float(tol))
    return pipeline(features, est).fit(d)


def evaluate_predictions(pred: DataFrame, labels: DataFrame, pred_col: str = "predicted_status") -> DataFrame:
    """I4: predictions joined to labels by user, then the per-class report (V5)."""
    from ..operators.metrics import class_report
    names = F.create_map(F.lit("not_churned"), F.lit(0), F.lit("vol_churn"), F.lit(1), F.lit("invol_churn"), F.lit(2))
    j = pred.select(KEY, F.element_at(names, F.col(pred_col)).alias("pred")).join(labels.select(KEY, "y"), KEY)
    return class_report(j, "y", "pred")


def imbalance_ablation(df: DataFrame, features: list[str], k: int = 3,
                       strategies=(None, "class_weight", "smote", "smote_enn", "adasyn")) -> DataFrame:
    """Macro F1 of the same two-stage recipe under each imbalance strategy, applied to
    the training rows of each fold."""
    from ..operators.metrics import hierarchical_to_3class, summary_f1
    d = prepare(df, features)
    rows = []
    for s in strategies:
        oof = two_stage_cv(d, features, "rf", "rf", k, params1={"numTrees": 20}, params2={"numTrees": 20}, sampler=s)
        p = oof.select("y", *hierarchical_to_3class(F.col("oof_s1"), F.col("oof_s2")))
        m = summary_f1(p.withColumn("pred", argmax3(F.col("p0"), F.col("p1"), F.col("p2"))), "y", "pred").first()
        rows.append((s or "none", float(m["macro_f1"]), float(m["weighted_f1"])))
    return df.sparkSession.createDataFrame(rows, "strategy string, macro_f1 double, weighted_f1 double") \
        .orderBy(F.col("macro_f1").desc())


def feature_subset_ablation(df: DataFrame, subsets: dict[str, list[str]], k: int = 3) -> DataFrame:
    """Macro F1 of the same learner per named feature subset."""
    from ..operators.metrics import summary_f1
    rows = []
    for name, cols in subsets.items():
        oof = multiclass_cv(df, cols, "rf", k, {"numTrees": 20})
        m = summary_f1(oof.withColumn("pred", argmax3(F.col("p0"), F.col("p1"), F.col("p2"))), "y", "pred").first()
        rows.append((name, len(cols), float(m["macro_f1"])))
    return df.sparkSession.createDataFrame(rows, "subset string, n_features int, macro_f1 double") \
        .orderBy(F.col("macro_f1").desc())
