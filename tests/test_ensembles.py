"""Stack with holdout, calibrated specialists, resumable search, graph runner."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators.metrics import log_loss
from churnkit.operators.sampling import assign_folds
from churnkit.plans import catalogue as C
from churnkit.plans import ensemble as E
from churnkit.plans.search import Range, Search, TrialStore, average_precision_objective, draw, macro_f1_objective
from churnkit.session import stored

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def users(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        y = rng.choice([0, 0, 1, 2])
        rows.append((i, y, rng.gauss(y, 1), rng.gauss(-y, 1.5) if rng.random() > .1 else None, rng.gauss(0, 1), rng.choice(["u", "v", None])))
    df = spark.createDataFrame(rows, "user_id long, y int, a double, b double, c double, g string")
    return stored(assign_folds(df.where("user_id < 150"), k=2)), stored(df.where("user_id >= 150"))


def specs():
    return E.base_learners(1, 2, 2)


def test_stack_has_15_meta_columns_and_holdout_means(users):
    tv, ho = users
    s = E.stack_with_holdout(tv, ho, FEATS, specs(), k=2, inner_k=2, grid=(0.01, 1.0), threads=4)
    meta = [f"{n.name}_p{i}" for n in specs() for i in range(3)]
    assert len(meta) == 15 and set(meta) < set(s.oof.columns) and set(meta) < set(s.holdout.columns) and s.strength in (0.01, 1.0)
    assert s.oof.count() == 150 and s.holdout.count() == 50
    for frame in (s.oof, s.holdout):
        for n in [x.name + "_" for x in specs()] + [""]:
            assert frame.where(F.abs(F.col(f"{n}p0") + F.col(f"{n}p1") + F.col(f"{n}p2") - 1) > 1e-9).count() == 0
    # a holdout column is the mean of that learner's fold models, and an out-of-fold one comes from the model without the fold
    forest = next(e for e in s.ensembles if e.name == "forest")
    each = [{r["user_id"]: r["q"][1] for r in m.apply(E.as_numbers(ho, FEATS), "q").collect()} for m in forest.by_fold.values()]
    for r in s.holdout.collect():
        assert r["forest_p1"] == pytest.approx(np.mean([m[r["user_id"]] for m in each]))
    for f, m in forest.by_fold.items():
        own = {r["user_id"]: r["forest_p2"] for r in s.oof.where(F.col("fold") == f).collect()}
        rows = tv.join(s.oof.where(F.col("fold") == f).select("user_id"), "user_id")
        assert own == pytest.approx({r["user_id"]: r["q"][2] for r in m.apply(E.as_numbers(rows, FEATS), "q").collect()})


def test_seeds_repeat_the_whole_stack(users):
    tv, ho = users
    few = [E.Learner("forest", "rf", {"numTrees": 2, "maxDepth": 3}), E.Learner("lr", "lr")]
    opts = dict(k=2, inner_k=2, grid=(1.0,), threads=4)
    oof, hold = E.seed_averaged_stack(tv, ho, FEATS, few, seeds=(1, 2), **opts)
    runs = [{r["user_id"]: r["p1"] for r in E.stack_with_holdout(tv, ho, FEATS, few, seed=s, **opts).holdout.collect()} for s in (1, 2)]
    assert oof.count() == 150 and runs[0] != runs[1]
    assert {r["user_id"]: r["p1"] for r in hold.collect()} == pytest.approx({u: (runs[0][u] + runs[1][u]) / 2 for u in runs[0]})


def test_sigmoid_fits_smoothed_targets(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s + 0.5))).astype(float)
    a, b = E.fit_sigmoid(spark.createDataFrame([(float(u), float(v)) for u, v in zip(s, y)], "s double, _yb double"))
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(np.mean(p - t)) < 1e-4 and abs(np.mean((p - t) * s)) < 1e-4        # the gradient vanishes


def test_calibrated_specialists(users):
    tv, ho = users
    raw = E.Learner("s", "gbt", {"maxIter": 8, "maxDepth": 5})
    oof, hold = E.calibrated_specialists(tv, ho, FEATS, raw, k=2, inner_k=2, holdout_k=2, threads=4)
    for frame, n in ((oof, 150), (hold, 50)):
        assert frame.count() == n and frame.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    ens = E.fit_folds(tv, FEATS, [raw], 2)
    plain = E.spread(E.out_of_fold(tv, FEATS, ens), "s")
    probs = ["p0", "p1", "p2"]
    assert log_loss(oof, "y", probs).first()[0] <= log_loss(plain, "y", probs).first()[0]


def test_search_resumes_without_refitting(spark, users, tmp_path):
    tv, _ = users
    calls = []

    def objective(train, valid, params):
        calls.append((params["x"], valid.first()["fold"]))
        if len(calls) == stop:
            raise KeyboardInterrupt
        return -abs(params["x"] - 0.3)

    d = tv.withColumn("fold", F.pmod("user_id", F.lit(3)))
    s = Search(objective, {"x": Range(0, 1)}, k=3, trials=7, eta=2, threads=1)
    assert [n for n, _ in s.rungs()] == [7, 4, 2]
    stop = 6
    with pytest.raises(KeyboardInterrupt):
        s.run(d, TrialStore(spark, str(tmp_path)))
    xs = {t: draw(s.space, t, 42)["x"] for t in range(7)}
    first, stop = [(xs[r["trial"]], r["fold"]) for r in TrialStore(spark, str(tmp_path)).scores()], -1
    calls.clear()
    got = s.run(d, TrialStore(spark, str(tmp_path))).collect()
    assert not set(first) & set(calls) and len(first) >= 5 and len(first) + len(calls) == 7 + 4 + 2 == s.fits
    # the furthest trial is the best by the objective, and every trial has its drawn parameters
    assert got[0]["trial"] == min(xs, key=lambda t: abs(xs[t] - 0.3)) and got[0]["complete"] and sum(r["complete"] for r in got) == 2
    calls.clear()
    again = Search(objective, s.space, k=3, trials=7, eta=2, threads=1)
    assert again.run(d, TrialStore(spark, str(tmp_path))).collect() == got and not calls and again.fits == 0
    # no time left: nothing is fitted; the default number of trials
    late = Search(objective, s.space, k=3, trials=2, seconds=0.0)
    assert late.run(d, TrialStore(spark, str(tmp_path / "other"))).count() == 0 and not calls and Search(objective, {}).trials == 50


def test_objectives(users):
    tv, _ = users
    tr, va = tv.where("fold = 0"), tv.where("fold = 1")
    assert 0.3 < macro_f1_objective("rf", FEATS)(tr, va, {"numTrees": 3}) <= 1
    b = lambda d: d.withColumn("y", (F.col("y") > 0).cast("int"))
    assert 0.5 < average_precision_objective("rf", FEATS)(b(tr), b(va), {"numTrees": 3}) <= 1


def fixed(p0):
    """An entry without a model."""
    def run(x, done):
        calls.append(p0)
        if p0 in broken:
            raise ValueError("broken")
        base = sum((f.count() for f in done.values()), 0)
        d = x.trainval.select(F.lit("oof").alias("part"), "user_id", "y").unionByName(x.holdout.select(F.lit("holdout").alias("part"), "user_id", "y"))
        return d.select("*", F.lit(p0).alias("p0"), F.lit((1 - p0) / 2).alias("p1"), F.lit((1 - p0) / 2 + 0 * base).alias("p2"))
    return run


calls, broken = [], set()


def test_runner_isolates_failures_and_resumes(spark, users, tmp_path):
    tv, ho = users
    x = C.Inputs(tv, ho, {"all": FEATS}, k=2)
    entries = [C.Entry("late", fixed(0.1), ("one", "two")), C.Entry("one", fixed(0.2)), C.Entry("two", fixed(0.3)), C.Entry("three", fixed(0.4)),
               C.Entry("after", fixed(0.5), ("three",)), C.Entry("lost", fixed(0.6), ("nowhere",))]
    store = C.RunStore(spark, str(tmp_path))
    broken.add(0.4)
    out = {(r["recipe"], r["part"]): r for r in C.run_catalogue(x, store, entries).collect()}
    assert out["three", None]["status"].startswith("failed: ValueError") and out["after", None]["status"] == "skipped: needs three"
    assert out["lost", None]["status"] == "skipped: needs nowhere" and calls.index(0.1) > max(calls.index(0.2), calls.index(0.3))
    assert all(out[n, p]["status"] == "ok" and out[n, p]["rows"] == k for n in ("late", "one", "two") for p, k in (("oof", 150), ("holdout", 50)))
    # a second run takes up what is finished and runs only the rest, also when an entry died between its rows and its metrics
    import shutil
    shutil.rmtree(tmp_path / "results" / "one")
    calls.clear(), broken.clear()
    out = C.run_catalogue(x, store, entries)
    status = {r["recipe"]: r["status"] for r in out.collect()}
    assert sorted(calls) == [0.2, 0.4, 0.5] and status["late"] == status["two"] == "resumed" and status["three"] == status["after"] == "ok"
    store.write_files(out)
    assert spark.read.option("header", True).csv(f"{tmp_path}/results_csv").count() == out.count()
    assert spark.read.json(f"{tmp_path}/results_json").where("entry = 'late' and macro_f1 is not null").count() == 2
    calls.clear()
    only = {r["recipe"]: r["status"] for r in C.run_catalogue(x, C.RunStore(spark, str(tmp_path / "new")), entries, only=["late", "two"]).collect()}
    assert only == {"late": "skipped: needs one", "two": "ok"} and calls == [0.3]


def test_catalogue_names_and_needs():
    entries = C.full_catalogue()
    names = [e.name for e in entries]
    assert len(set(names)) == len(names) and set("ABCDEFGHIJKLMN") | {"Kv2", "Lv2", "Mv2", "Nv2"} | {f"P{i:02d}" for i in range(1, 14)} <= \
        {n.split("_")[0] for n in names}
    assert all(n in names for e in entries for n in e.needs)


def test_real_entries_obey_their_fields(users):
    tv, ho = users
    x = C.Inputs(tv, ho, {"all": FEATS, "v1": ["a", "b"], "payment": ["b", "c"]}, ("g",), k=2, rounds=1, trees=2, depth=2)
    by = {e.name: e for e in C.full_catalogue()}
    c = by["C"].run(x, {})
    for name in ("C", "P07_smote_enn"):
        out = c if name == "C" else by[name].run(x, {})
        n = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
        assert n == ({"oof": 150, "holdout": 50} if not name.startswith("P07") else {"oof": 150})
        assert out.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    # out of fold, stage 2 scores churned rows only; on the holdout every row
    assert c.where("part = 'oof' and y = 0 and p2 > 0").count() == 0 and c.where("part = 'holdout' and y = 0 and p2 > 0").count() > 0
    rows = C.balanced_rows(tv.fillna(0.0), FEATS, "adasyn").groupBy("y").count().collect()
    assert len({r["count"] for r in rows}) == 1
