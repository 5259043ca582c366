"""The catalogue of named recipes and its runner.

An entry is a function from the inputs and the stored results of the entries it needs to
probabilities: ``user_id, y, part ("oof" or "holdout"), p0, p1, p2``.  :func:`run_catalogue` works on the graph
of needs: an entry starts as soon as those it needs are there, independent ones run side by side,
one that fails is a row with its error and skips only those that need it.  Results lie in a store in
shared storage; an entry counts as finished once its metrics are written, so a run that was killed goes on with
the entries that were not.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blend import alpha_search, em_simplex_weights
from ..operators.metrics import average_precision, hierarchical_to_3class, log_loss, summary_f1
from ..operators.sampling import adasyn, correlation_filter, enn_clean, permutation_importance, smote, vif_filter
from ..session import stored
from . import models as MD
from .ensemble import (Learner, _fills, as_numbers, base_learners, calibrated_specialists, fit_scorer, fold_means, fit_folds, out_of_fold,
                       seed_averaged_stack, side_by_side, spread, stack_with_holdout)
from .models import KEY
from .search import BOOSTER_SPACE, FOREST_SPACE, Search, TrialStore, average_precision_objective, macro_f1_objective


@dataclass
class Inputs:
    """What recipes read: training rows (``user_id, y, fold``, features), holdout rows, feature lists and sizes."""
    trainval: DataFrame
    holdout: DataFrame | None
    sets: dict[str, list[str]]                 # "all", "v1", "payment", "artifacts"
    categoricals: tuple = ()
    k: int = 5
    rounds: int = 500
    trees: int = 500
    depth: int = 6
    trials: int = 50
    seeds: tuple = (42, 123, 256, 512, 999)
    top: tuple = (80, 50)                      # cuts of the permutation ranking
    threads: int = 4
    space: dict | None = None                  # overrides the searched booster space
    forest_space: dict | None = None
    store: str = ""                            # set by run_catalogue: where searches keep their trials

    def features(self, name: str) -> list[str]:
        return self.sets.get(name, self.sets["all"])

    def boost(self, name="boost", **params) -> Learner:
        return Learner(name, "gbt", {"maxIter": self.rounds, "maxDepth": self.depth, "stepSize": 0.05, **params})

    def cat(self, name="cat") -> Learner:
        return Learner(name, "gbt", {"maxIter": self.rounds, "maxDepth": self.depth, "stepSize": 0.05}, tuple(self.categoricals))


@dataclass
class Entry:
    """A named recipe; ``threshold_rule`` as in :func:`models.decide`."""
    name: str
    run: Callable[[Inputs, dict[str, DataFrame]], DataFrame]
    needs: tuple = ()
    threshold_rule: str = "argmax"
    params: dict = field(default_factory=dict)


# ------------------------------------------------------------------- building blocks
def _parts(oof: DataFrame, hold: DataFrame | None) -> DataFrame:
    cols = [KEY, "y", "p0", "p1", "p2"]
    out = oof.select(F.lit("oof").alias("part"), *cols)
    return out if hold is None else out.unionByName(hold.select(F.lit("holdout").alias("part"), *cols))


def flat(learner_of: Callable[[Inputs], Learner], features: str = "all", refit: bool = True, sampler: str | None = None):
    """One three-class learner by fold; the holdout by a refit on all rows (or by the fold models' mean)."""
    def run(x: Inputs, _):
        spec, feats = learner_of(x), x.features(features)
        if sampler:
            return _parts(*_resampled(x, spec, feats, sampler))
        ens = fit_folds(x.trainval, feats, [spec], x.k, threads=x.threads)
        oof = spread(out_of_fold(x.trainval, feats, ens).withColumnRenamed(spec.name, "_p"), "_p")
        hold = None
        if x.holdout is not None and refit:
            late = Learner(spec.name, spec.kind, {n: v for n, v in spec.params.items() if n != "early"}, spec.categoricals)
            hold = spread(fit_scorer(x.trainval, feats, late, threads=x.threads).apply(as_numbers(x.holdout, feats), "_p"), "_p")
        elif x.holdout is not None:
            hold = spread(fold_means(x.holdout, feats, ens).withColumnRenamed(spec.name, "_p"), "_p")
        return _parts(oof, hold)
    return run


def balanced_rows(train: DataFrame, features: list[str], sampler: str) -> DataFrame:
    """Training rows of three classes, every smaller class filled up to the largest; weights are 1.

    ``train`` has no NULL.  "raw" changes nothing, "smote_enn" cleans after filling up."""
    one = F.lit(1.0).alias("_w")
    d = train.select(F.col(KEY).cast("string").alias(KEY), "y", *features)
    if sampler != "raw":
        counts = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
        most = max(counts.values())
        fill = adasyn if sampler == "adasyn" else smote
        made = [fill(d, "y", features, KEY, minority=c, n_new=most - n).where("synthetic = 1")
                .withColumn(KEY, F.concat(F.lit(f"{c}_"), KEY)).select(*d.columns) for c, n in counts.items() if n < most]
        d = stored(reduce(lambda a, b: a.unionByName(b), made, d), "balanced")
        if sampler == "smote_enn":
            d = enn_clean(d, "y", features, KEY)
    return d.select("*", one)


def _filled(x: Inputs, train: DataFrame, rows: DataFrame, feats: list[str]) -> DataFrame:
    """Features with the medians of ``train`` in place of NULL."""
    out = _fills(as_numbers(train, feats), feats, True).transform(as_numbers(rows, feats))
    return out.select(*[c for c in rows.columns if c not in feats], *[F.col(f"_x_{c}").alias(c) for c in feats])


def _resampled(x: Inputs, spec: Learner, feats: list[str], sampler: str):
    def one(f):
        tr, va = x.trainval.where(F.col("fold") != f), x.trainval.where(F.col("fold") == f)
        rows = balanced_rows(_filled(x, tr, tr, feats), feats, sampler)
        return fit_scorer(rows, feats, spec).apply(_filled(x, tr, va, feats), "_p").select(KEY, "y", "_p")
    parts = side_by_side([lambda f=f: one(f) for f in range(x.k)], x.threads)
    return spread(reduce(lambda a, b: a.unionByName(b), parts), "_p"), None


class Vote:
    """T4: weighted mean of several learners' probabilities."""

    def __init__(self, learners: list[Learner], weights: list[float]):
        self.learners, self.weights = learners, weights


class BinaryStack:
    """T5: learners by inner fold, a logistic regression over their out-of-fold scores, learners refitted on all rows."""

    def __init__(self, learners: list[Learner], inner_k: int = 3):
        self.learners, self.inner_k = learners, inner_k


def fit_binary(train: DataFrame, features: list[str], model, label: str, valid: DataFrame | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds P(label = 1) to rows, for a Learner, a Vote or a BinaryStack."""
    if isinstance(model, Learner):
        m = fit_scorer(train, features, model, label, 2, valid=valid)

        def one(df, out):
            cols = df.columns
            return m.apply(as_numbers(df, features), "_b").select(*cols, F.col("_b")[1].alias(out))
        return one
    fitted = [fit_binary(train, features, m, label, valid) for m in model.learners]
    names = [f"_m{i}" for i in range(len(fitted))]

    def every(df):
        for f, n in zip(fitted, names):
            df = f(df, n)
        return df
    if isinstance(model, Vote):
        total = float(sum(model.weights))
        mean = reduce(lambda a, b: a + b, [F.col(n) * (w / total) for n, w in zip(names, model.weights)])
        return lambda df, out: every(df).select(*df.columns, mean.alias(out))
    inner = train.withColumn("_in", F.pmod(F.xxhash64(KEY, F.lit(9)), F.lit(model.inner_k)))
    seen = []
    for j in range(model.inner_k):
        rest, part = inner.where(F.col("_in") != j), inner.where(F.col("_in") == j)
        for m, n in zip(model.learners, names):
            part = fit_binary(rest, features, m, label)(part, n)
        seen.append(part.select(label, *names))
    meta = fit_binary(stored(reduce(lambda a, b: a.unionByName(b), seen), "binary-stack"), names, Learner("meta", "lr", {"elasticNetParam": 0.0, "regParam": 0.0}), label)
    return lambda df, out: meta(every(df), out).select(*df.columns, out)


def two_stage(s1, s2, features1: str = "all", features2: str = "all", min_churn: int = 10, smote_first: bool = False,
              columns: Callable[[Inputs], list[str]] | None = None):
    """Churn on all rows, then involuntary given churn on churned rows; soft handoff to three classes.

    Out of fold, stage 2 scores churned rows only (others get 0); on the holdout it scores every row."""
    def run(x: Inputs, _):
        f1 = columns(x) if columns else x.features(features1)
        f2 = x.features(features2)
        d = x.trainval.withColumns({"_c": (F.col("y") > 0).cast("int"), "_i": (F.col("y") == 2).cast("int")})
        m1, m2 = s1(x), s2(x)

        def stages(tr, score_all, va):
            a = _filled(x, tr, tr, f1) if smote_first else tr
            b = _filled(x, tr, va, f1) if smote_first else va
            if smote_first:
                a = smote(a.select(F.col(KEY).cast("string").alias(KEY), "_c", *f1), "_c", f1, KEY).withColumn("_w", F.lit(1.0))
            first = fit_binary(a, f1, m1, "_c", None if smote_first else va.where("_c is not null"))(b, "s1").select(KEY, "y", "s1")
            churned = tr.where("_c = 1")
            if churned.count() <= min_churn:
                return first.withColumn("s2", F.lit(0.0))
            rows = va if score_all else va.where("_c = 1")
            second = fit_binary(churned, f2, m2, "_i")(rows, "s2").select(KEY, "s2")
            return first.join(second, KEY, "left").fillna(0.0, ["s2"])

        def fold(f):
            return stages(d.where(F.col("fold") != f), False, d.where(F.col("fold") == f))
        oof = reduce(lambda a, b: a.unionByName(b), side_by_side([lambda f=f: fold(f) for f in range(x.k)], x.threads))
        hold = None
        if x.holdout is not None:
            hold = stages(d, True, x.holdout.withColumns({"_c": (F.col("y") > 0).cast("int"), "_i": (F.col("y") == 2).cast("int")}))
        soft = [KEY, "y", *hierarchical_to_3class(F.col("s1"), F.col("s2"))]
        return _parts(oof.select(*soft), None if hold is None else hold.select(*soft))
    return run


def _tuned(x: Inputs, kind: str, space: dict, label: str | None = None, objective: str = "f1", tag: str = "") -> dict:
    """Best parameters of a search whose store lies beside the other results."""
    d = x.trainval if label is None else x.trainval.withColumn("y", F.col(label))
    feats = x.features("all")
    score = average_precision_objective(kind, feats) if objective == "ap" else macro_f1_objective(kind, feats, 3 if label is None else 2)
    s = Search(score, space, k=min(3, x.k), trials=x.trials, threads=x.threads)
    folds = d.withColumn("fold", F.pmod(F.col("fold"), F.lit(s.k)))
    store = TrialStore(d.sparkSession, f"{x.store}/trials-{kind}-{label or 'y'}-{objective}{tag}")
    return s.best(s.run(folds, store))


def _tuned_flat(kind: str, **fixed):
    def run(x: Inputs, done):
        space = (x.forest_space or FOREST_SPACE) if kind == "rf" else (x.space or BOOSTER_SPACE)
        best = _tuned(x, kind, space, tag="".join(f"-{n}" for n in sorted(fixed)))
        return flat(lambda _: Learner("tuned", kind, {**best, **fixed}))(x, done)
    return run


def _tuned_two_stage(x: Inputs, done):
    d = x.trainval.withColumns({"_c": (F.col("y") > 0).cast("int"), "_i": (F.col("y") == 2).cast("int")})
    y = _with(x, trainval=d)
    p1 = _tuned(y, "gbt", x.space or BOOSTER_SPACE, "_c")
    p2 = _tuned(_with(y, trainval=d.where("_c = 1")), "gbt", x.space or BOOSTER_SPACE, "_i")
    return two_stage(lambda _: Learner("s1", "gbt", p1), lambda _: Learner("s2", "gbt", p2), min_churn=20)(x, done)


def _with(x: Inputs, **changes) -> Inputs:
    from copy import copy
    out = copy(x)
    for n, v in changes.items():
        setattr(out, n, v)
    return out


def _blend(frames: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the entries' probabilities per row and part."""
    rows = reduce(lambda a, b: a.unionByName(b), [
        f.select("part", KEY, "y", *[(F.col(f"p{i}") * weights[n]).alias(f"p{i}") for i in range(3)]) for n, f in frames.items()])
    return rows.groupBy("part", KEY, "y").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(3)]) \
        .where(F.col("_n") == len(frames)).drop("_n")


def _side(frames: dict[str, DataFrame], names) -> DataFrame:
    """Out-of-fold rows with the probabilities of several entries as ``<entry>_p<class>``."""
    first = frames[names[0]].where("part = 'oof'").select(KEY, "y", *[F.col(f"p{i}").alias(f"{names[0]}_p{i}") for i in range(3)])
    for n in names[1:]:
        first = first.join(frames[n].where("part = 'oof'").select(KEY, *[F.col(f"p{i}").alias(f"{n}_p{i}") for i in range(3)]), KEY)
    return first


def _best_weights(names):
    def run(x, done):
        w = em_simplex_weights(_side(done, names), "y", [[f"{n}_p{i}" for i in range(3)] for n in names])
        return _blend({n: done[n] for n in names}, dict(zip(names, w)))
    return run


def _alpha(a: str, b: str):
    def run(x, done):
        best = alpha_search(_side(done, [a, b]), "y", [f"{a}_p{i}" for i in range(3)], [f"{b}_p{i}" for i in range(3)]).first()["alpha"]
        return _blend({a: done[a], b: done[b]}, {a: best, b: 1 - best})
    return run


def _best_of(names):
    def run(x, done):
        def score(n):
            return summary_f1(MD.decide(MD.Recipe(n), done[n].where("part = 'oof'")), "y", "pred").first()["macro_f1"]
        return done[max(names, key=lambda n: (score(n), n))]
    return run


def _stack(x: Inputs, _):
    s = stack_with_holdout(x.trainval, x.holdout, x.features("all"), base_learners(x.rounds, x.trees, x.depth), k=x.k, threads=x.threads)
    out = s.oof.select(F.lit("oof").alias("part"), *[c for c in s.oof.columns if c != "fold"])
    return out if s.holdout is None else out.unionByName(s.holdout.select(F.lit("holdout").alias("part"), *s.holdout.columns))


def _neural_meta(x: Inputs, done):
    """P10: a network over the stack's meta columns instead of the logistic regression."""
    meta = done["P04"]
    cols = [c for c in meta.columns if c.endswith(("_p0", "_p1", "_p2"))]
    d = meta.where("part = 'oof'").join(x.trainval.select(KEY, "fold"), KEY)
    hold = meta.where("part = 'holdout'").drop("part", "p0", "p1", "p2") if x.holdout is not None else None
    return flat(lambda _: Learner("meta_net", "mlp", {"hidden": 32}), refit=False)(
        _with(x, trainval=d.drop("part", "p0", "p1", "p2"), holdout=hold, sets={"all": cols}), done)


def _important(x: Inputs, keep: int) -> list[str]:
    """The first ``keep`` features by Shapley values of a quick booster for churn."""
    feats = x.features("v1")
    d = x.trainval.withColumn("y", (F.col("y") > 0).cast("int"))
    m = MD.final_fit(d, feats, "gbt", {"maxIter": max(2, x.rounds * 3 // 5), "maxDepth": min(5, x.depth)})
    top = (MD.tree_contributions(m, d, feats).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("v"))
           .orderBy(F.col("v").desc(), "feature").limit(keep).collect())
    return [r["feature"] for r in top]


def _subset(kind: str):
    """The same booster on a screened feature list."""
    def run(x: Inputs, done):
        feats = x.features("all")
        if kind.startswith("top"):
            place = ["top_a", "top_b"].index(kind)
            m = MD.final_fit(x.trainval, feats, "rf", {"numTrees": max(5, x.trees * 2 // 5), "maxDepth": 8})
            ranked = permutation_importance(m, x.trainval, feats, repeats=5).limit(x.top[place]).collect()
            cols = [r["feature"] for r in ranked]
        else:
            cols = {"all": lambda d, f: f, "corr": correlation_filter, "vif": vif_filter}[kind](x.trainval, feats)
        return flat(lambda y: y.boost())(_with(x, sets={"all": cols}), done)
    return run


def full_catalogue() -> list[Entry]:
    """A-J and K-N on the first matrix, Kv2-Nv2 on the second, P01-P13; boosters are gradient-boosted trees, three
    one-vs-rest models for three classes."""
    b, b2 = (lambda x: x.boost()), (lambda x: x.boost("sub", subsamplingRate=0.8))
    early = lambda x: x.boost(early=0.001)                                             # noqa: E731
    net, lr = (lambda x: Learner("net", "mlp")), (lambda x: Learner("lr", "lr"))
    cat = lambda x: x.cat()                                                            # noqa: E731
    forest = lambda x: Learner("forest", "rf", {"numTrees": x.trees, "maxDepth": 8})
    blend3 = lambda x: Vote([x.boost(), x.cat(), Learner("net", "mlp")], [.4, .4, .2])
    vote = lambda x: Vote([x.boost(), Learner("forest", "rf", {"numTrees": x.trees}), Learner("lr", "lr")], [2, 2, 1])
    stacked = lambda x: BinaryStack([x.boost(), Learner("forest", "rf", {"numTrees": x.trees}), Learner("lr", "lr")])
    speed = ["engagement_velocity", "credit_cost_decimal"]
    signal = speed + ["credit_regularity_score", "inter_gen_regularity"]
    plus = lambda extra: lambda x: x.features("v1") + [c for c in extra if c in x.trainval.columns and c not in x.features("v1")]

    def tuned_s1(x, done):
        d = x.trainval.withColumn("_c", (F.col("y") > 0).cast("int"))
        best = _tuned(_with(x, trainval=d), "gbt", x.space or BOOSTER_SPACE, "_c", "ap", "-G")
        return two_stage(lambda _: Learner("s1", "gbt", best), b2, "v1", "payment")(x, done)

    def artifacts(x, done):
        cols = x.features("all") + [c for c in x.features("artifacts") if c not in x.features("all")]
        fine = flat(lambda y: y.boost(maxBins=128))(_with(x, sets={"all": cols}), done)
        return fine if "P04" not in done else _blend({"fine": fine, "P04": done["P04"]}, {"fine": 0.5, "P04": 0.5})

    def network(x, done):
        return _blend({"net": flat(net)(x, done), "P04": done["P04"]}, {"net": 0.3, "P04": 0.7})

    def specialists(x, _):
        return _parts(*calibrated_specialists(x.trainval, x.holdout, x.features("all"), x.boost(), k=x.k, threads=x.threads))

    def seeds(x, _):
        return _parts(*seed_averaged_stack(x.trainval, x.holdout, x.features("all"), base_learners(x.rounds, x.trees, x.depth), x.seeds, k=x.k,
                                           grid=(0.01, 0.1, 1.0, 10.0), inner_k=3, threads=x.threads))

    f1 = "best_f1"
    out = [Entry("A", two_stage(b, b2, "v1", "payment"), (), f1), Entry("B", two_stage(b, lr, "v1", "payment"), (), f1),
           Entry("C", two_stage(cat, cat, "v1", "payment"), (), f1), Entry("D", two_stage(stacked, vote, "v1", "payment"), (), f1),
           Entry("E", two_stage(blend3, b, "v1", "payment", columns=plus(speed)), (), f1),
           Entry("F", two_stage(blend3, b, "v1", "payment", columns=plus(signal)), (), f1),
           Entry("G", tuned_s1, (), f1), Entry("H", two_stage(net, lr, "v1", "payment"), (), f1),
           Entry("I", two_stage(b, b2, "v1", "payment", smote_first=True), (), f1),
           Entry("J", two_stage(cat, cat, "v1", "payment", columns=lambda x: _important(x, 60)), (), f1)]
    for tag, feats in (("", "v1"), ("v2", "all")):
        out += [Entry(f"K{tag}", flat(early, feats)), Entry(f"L{tag}", flat(b2, feats)), Entry(f"M{tag}", flat(cat, feats)),
                Entry(f"N{tag}", two_stage(b, b, feats, feats), (), "joint")]
    out += [Entry("P01", flat(early)), Entry("P02_boost", _tuned_flat("gbt")), Entry("P02_sub", _tuned_flat("gbt", featureSubsetStrategy="0.8")),
            Entry("P02_forest", _tuned_flat("rf")), Entry("P02", _best_of(["P02_boost", "P02_sub", "P02_forest"]), ("P02_boost", "P02_sub", "P02_forest")),
            Entry("P03", _best_weights(["P02_boost", "P02_sub", "P02_forest"]), ("P02_boost", "P02_sub", "P02_forest")),
            Entry("P04", _stack), Entry("P05", _tuned_two_stage), Entry("P06", _alpha("P04", "P05"), ("P04", "P05"))]
    out += [Entry(f"P07_{s}", flat(b, sampler=None if s == "class_weight" else s, refit=False)) for s in ("raw", "class_weight", "smote", "smote_enn", "adasyn")]
    out += [Entry(f"P08_{s}", _subset(s)) for s in ("all", "top_a", "top_b", "vif", "corr")]
    return out + [Entry("P09", seeds), Entry("P10", _neural_meta, ("P04",)), Entry("P11", network, ("P04",)), Entry("P12", specialists),
                  Entry("P13", artifacts, ("P04",)), Entry("S_rf", flat(forest)), Entry("S_lr", flat(lr))]


# ------------------------------------------------------------------- runner
_RESULT = ("recipe string, status string, part string, rows long, accuracy double, macro_f1 double, weighted_f1 double, "
           "pr_auc_macro double, logloss double, seconds double")


class RunStore:
    """Probabilities and metrics per entry under one folder; metrics are written last and mark an entry as finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        try:
            r = self.spark.read
            return (r.schema(schema) if schema else r).parquet(path)
        except AnalysisException:
            return None

    def finished(self, name: str) -> DataFrame | None:
        """The stored probabilities of a finished entry."""
        return None if self._read(f"{self.path}/results/{name}", _RESULT) is None else self._read(f"{self.path}/oof/{name}")

    def result(self, name: str) -> list:
        return self._read(f"{self.path}/results/{name}", _RESULT).collect()        # one row per part

    def save(self, name: str, oof: DataFrame, metrics: Callable[[DataFrame], list[tuple]]) -> tuple[DataFrame, list]:
        oof.write.mode("overwrite").parquet(f"{self.path}/oof/{name}")
        back = self._read(f"{self.path}/oof/{name}")
        rows = metrics(back)
        self.spark.createDataFrame(rows, _RESULT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/results/{name}")
        return back, rows

    def write_files(self, leaderboard: DataFrame) -> None:
        """The leaderboard as CSV, and each entry's metrics as a JSON file."""
        leaderboard.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.path}/results_csv")
        leaderboard.withColumn("entry", F.col("recipe")).write.mode("overwrite").partitionBy("entry").json(f"{self.path}/results_json")


def metrics_of(entry: Entry, frame: DataFrame, seconds: float) -> list[tuple]:
    """One row per part: F1 family by the entry's decision rule, macro average precision, log loss."""
    rows = []
    for part in ("oof", "holdout"):
        d = frame.where(F.col("part") == part)
        n = d.count()
        if not n:
            continue
        m = summary_f1(MD.decide(entry, d), "y", "pred").first()
        ap = []
        for c in range(3):
            got = average_precision(d.select((F.col("y") == c).cast("int").alias("h"), F.col(f"p{c}").alias("s")), "h", "s").first()
            ap.append(got[0] or 0.0 if got else 0.0)
        ll = log_loss(d, "y", ["p0", "p1", "p2"]).first()[0]
        rows.append((entry.name, "ok", part, n, float(m["accuracy"]), float(m["macro_f1"]), float(m["weighted_f1"]), sum(ap) / 3, float(ll), seconds))
    return rows


def run_catalogue(x: Inputs, store: RunStore, entries: list[Entry] | None = None, only: list[str] | None = None, skip: list[str] = (),
                  start: str | None = None, side: int = 3) -> DataFrame:
    """The leaderboard of all entries; ``side`` of them run at a time.

    ``only``, ``skip`` and ``start`` (from this entry on) choose entries; what a chosen entry needs and is neither chosen nor
    finished makes it a row ``skipped: needs ...``."""
    entries = entries or full_catalogue()
    names = [e.name for e in entries]
    chosen = [e for e in entries if (not only or e.name in only) and e.name not in skip and (start is None or names.index(e.name) >= names.index(start))]
    x = _with(x, store=store.path)
    done: dict[str, DataFrame] = {}
    rows: list[tuple] = []
    for e in entries:
        held = store.finished(e.name)
        if held is not None:
            done[e.name] = held
            if e in chosen:
                rows += [(r["recipe"], "resumed", *list(r)[2:]) for r in store.result(e.name)]
    waiting = [e for e in chosen if e.name not in done]
    lost: set[str] = set()
    blank = (None,) * 8

    def work(e):
        began = time.monotonic()
        return store.save(e.name, e.run(x, {n: done[n] for n in e.needs}), lambda f: metrics_of(e, f, time.monotonic() - began))

    with ThreadPoolExecutor(max_workers=max(1, side)) as pool:
        running = {}
        while waiting or running:
            for e in list(waiting):
                open_ = [n for n in e.needs if n not in done]
                never = [n for n in open_ if n in lost or n not in [w.name for w in waiting] + [r.name for r in running.values()]]
                if never:
                    waiting.remove(e)
                    lost.add(e.name)
                    rows.append((e.name, f"skipped: needs {', '.join(never)}", *blank))
                elif not open_ and len(running) < side:
                    waiting.remove(e)
                    running[pool.submit(work, e)] = e
            if not running:
                continue
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                e = running.pop(f)
                try:
                    done[e.name], got = f.result()
                    rows += got
                except Exception as err:  # one entry's failure must not lose the others' results
                    lost.add(e.name)
                    rows.append((e.name, f"failed: {type(err).__name__}: {str(err)[:200]}", *blank))
    out = x.trainval.sparkSession.createDataFrame(rows, _RESULT)
    return out.orderBy(F.col("part").desc_nulls_last(), F.col("macro_f1").desc_nulls_last(), "recipe")
