"""Model helpers, sinks and k-NN resampling on small inline data."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnkit.operators import sampling as S
from churnkit.plans import models as MD
from churnkit.sources import tables as TB


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, i % 3, float(i % 7), float((i * 13) % 11), float(i % 3) + (i % 5) * 0.1) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, y int, a double, b double, c double")
    return S.assign_folds(df, k=3)


def test_two_stage_cv_rows_and_ranges(data):
    oof = MD.two_stage_cv(data, ["a", "b", "c"], k=3, params1={"maxIter": 5}, params2={"maxIter": 5})
    assert oof.count() == 90
    r = oof.agg(F.min("oof_s1"), F.max("oof_s1")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_multiclass_probabilities_sum_to_one(data):
    oof = MD.multiclass_cv(data, ["a", "b", "c"], "rf", 3, {"numTrees": 5})
    bad = oof.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-6).count()
    assert oof.count() == 90 and bad == 0


def test_tree_contributions_additive(data):
    d = data.withColumn("y", (F.col("y") > 0).cast("int"))
    m = MD.final_fit(d, ["a", "b", "c"], "gbt", {"maxIter": 5, "maxDepth": 3})
    c = MD.tree_contributions(m, d, ["a", "b", "c"])
    assert c.agg(F.max("additivity_error")).first()[0] < 1e-9


def test_tree_values_are_shapley_values(data):
    """Against all coalitions: features outside one follow the training cover."""
    import math
    from itertools import combinations

    import numpy as np
    feats = ["a", "b", "c"]
    d = data.withColumn("y", (F.col("y") > 0).cast("int"))
    for kind, params in (("gbt", {"maxIter": 3, "maxDepth": 4}), ("rf", {"numTrees": 3, "maxDepth": 4})):
        df = d if kind == "gbt" else data
        m = MD.final_fit(df, feats, kind, params)
        c = MD.tree_contributions(m, df, feats)
        assert c.agg(F.max("additivity_error")).first()[0] < 1e-9
        x = np.array([list(r) for r in MD.prepare(df, feats).select(*feats).limit(8).collect()], dtype=float)

        def expect(tree, node, row, known):
            f = tree["feat"][node]
            if f < 0:
                return np.asarray(tree["value"][node])
            kids = tree["left"][node], tree["right"][node]
            if f in known:
                return expect(tree, kids[0] if row[f] <= tree["thr"][node] else kids[1], row, known)
            return sum(tree["cover"][k] / tree["cover"][node] * expect(tree, k, row, known) for k in kids)

        for tree in MD.tree_table(m.stages[-1]):
            phi, base = MD.tree_shap(tree, x)
            for i, row in enumerate(x):
                assert np.allclose(base, expect(tree, 0, row, ()))
                for j in range(3):
                    others = [k for k in range(3) if k != j]
                    want = sum(math.factorial(n) * math.factorial(2 - n) / 6
                               * (expect(tree, 0, row, (*s, j)) - expect(tree, 0, row, s))
                               for n in range(3) for s in combinations(others, n))
                    assert np.allclose(phi[i, j], want)


def test_final_fit_persists(spark, data):
    path = tempfile.mkdtemp(prefix="churnkit-model-") + "/m"
    MD.final_fit(data, ["a", "b", "c"], "rf", {"numTrees": 5}, path=path, meta={"run": "t"})
    assert os.path.exists(path) and os.path.exists(path + "_meta")


def test_sinks_roundtrip(spark, data):
    base = tempfile.mkdtemp(prefix="churnkit-sink-")
    TB.save_oof(data.select("user_id", F.lit(0.5).alias("p0")), base + "/oof", "r1")
    assert TB.load_oof(spark, base + "/oof", "r1").count() == 90
    built = TB.read_through(spark, base + "/feat", lambda: data)
    again = TB.read_through(spark, base + "/feat", lambda: 1 / 0)   # cached: builder not called
    assert built.count() == again.count() == 90
    TB.write_predictions(data.select("user_id", F.lit("vol_churn").alias("predicted_label")), base + "/pred")
    assert spark.read.option("header", True).csv(base + "/pred").columns == ["user_id", "predicted_label"]


def test_smote_balances_and_stays_in_hull(spark):
    rows = [(str(i), 0, float(i), float(i)) for i in range(20)] + [(f"m{i}", 1, 100.0 + i, 50.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, y int, f1 double, f2 double")
    out = S.smote(df, "y", ["f1", "f2"], "id", k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 20
    syn = out.where("synthetic = 1").agg(F.min("f1"), F.max("f1"), F.min("f2"), F.max("f2")).first()
    assert 100.0 <= syn[0] <= syn[1] <= 104.0 and syn[2] == syn[3] == 50.0


def test_smote_query_interpolates_to_true_neighbours_in_all_dimensions(spark):
    import numpy as np
    from churnkit.plans.q_sampling import q_smote
    from churnkit.sources.fixtures import read_driver
    SF = "/root/testdata/sf0.001"
    given = {str(r["vec_id"]): (r["label"], np.array(r["embedding"], dtype=float)) for r in read_driver(spark, SF, "embeddings").collect()}
    minority = {k: v for k, (label, v) in given.items() if label == 0}
    rows = q_smote(spark, SF).collect()
    old, new = [r for r in rows if not r["synthetic"]], [r for r in rows if r["synthetic"]]
    assert {r["vec_id"]: list(r["vector"]) for r in old} == {k: list(v) for k, (_, v) in given.items()}
    assert len(new) == len(given) - 2 * len(minority) and len({r["vec_id"] for r in new}) == len(new)
    for r in new:
        base, near = minority[r["base"]], minority[r["neighbour"]]
        fifth = sorted(np.linalg.norm(base - v) for k, v in minority.items() if k != r["base"])[4]
        assert 0 < np.linalg.norm(base - near) <= fifth + 1e-9 and 0 <= r["gap"] < 1
        assert np.allclose(r["vector"], base + r["gap"] * (near - base))


def test_csv_loader_repairs_years(spark):
    d = tempfile.mkdtemp(prefix="churnkit-csv-")
    with open(f"{d}/train_users_purchases.csv", "w") as fh:
        fh.write("Unnamed: 0,user_id,transaction_id,purchase_time,purchase_type,purchase_amount_dollars\n")
        fh.write("0,u1,t1,1067-08-25 00:23:10.133678+00:00,Upsell,9.5\n1,u2,t2,junk,Upsell,3\n")
    df = TB.load_table(spark, d, "train_users", "purchases")
    r = {x["user_id"]: x for x in df.collect()}
    assert r["u1"]["purchase_time"].year == 2023 and r["u2"]["purchase_time"] is None
    assert TB.load_table(spark, d, "train_users", "quizzes", optional=True) is None


def test_recipe_catalogue_runs(data):
    byname = {r.name: r for r in MD.CATALOGUE}
    for name in ("A", "K"):
        oof = MD.run_recipe(byname[name], data, ["a", "b", "c"], k=3)
        assert oof.count() == 90 and set(oof.columns) >= {"user_id", "p0", "p1", "p2"}


def test_catalogue_isolates_failures_and_obeys_fields(data):
    feats = ["a", "b", "c"]
    R = MD.Recipe
    recipes = [R("A", sampler=None), R("N", sampler=None, threshold_rule="joint"), R("K", multiclass="rf"),
               R("bad", features="nowhere"), R("after", blend=["bad"], depends_on=["bad"]),
               R("core", features="core", multiclass="rf"), R("mix", blend=["A", "K"], depends_on=["A", "K"])]
    out = {r["recipe"]: r for r in MD.run_catalogue(data, feats, recipes, feature_sets={"core": ["a"]}).collect()}
    assert out["bad"]["status"] == "failed: KeyError" and out["after"]["status"] == "skipped"
    assert all(out[n]["status"] == "ok" for n in ("A", "N", "K", "core", "mix"))
    # low churn probabilities: the argmax never says churn, chosen thresholds do
    low = data.sparkSession.createDataFrame([(i, i % 3, 0, 1 - c, c * (1 - v), c * v) for i in range(30)
                                             for c, v in [((0.1, 0.3, 0.3)[i % 3], (0.5, 0.2, 0.8)[i % 3])]],
                                            "user_id long, y int, fold int, p0 double, p1 double, p2 double")
    right = [MD.decide(r, low).where("y = pred").count() for r in (recipes[0], recipes[1], R("E", threshold_rule="best_f1"))]
    assert right == [10, 30, 30]
    a, k, mix = (MD.run_recipe(r, data, feats).orderBy("user_id").collect() for r in (recipes[0], recipes[2], recipes[6]))
    assert all(abs((x["p1"] + y["p1"]) / 2 - z["p1"]) < 1e-9 for x, y, z in zip(a, k, mix))
    smote = MD.resample(data.withColumn("yb", (F.col("y") == 2).cast("double")), "yb", feats, "smote")
    n = {r["yb"]: r["count"] for r in smote.groupBy("yb").count().collect()}
    assert n[0.0] == n[1.0]


def test_any_year_rewrite_and_user_universe(spark):
    from churnkit.functions.clean import any_year_to_2023
    df = spark.createDataFrame([("1999-05-01",), ("1067-01-02",)], "s string")
    assert [r[0] for r in df.select(any_year_to_2023("s")).collect()] == ["2023-05-01", "2023-01-02"]
    a = spark.createDataFrame([("u2",), ("u1",)], "user_id string")
    b = spark.createDataFrame([("u3",), (None,)], "user_id string")
    uni = TB.user_universe({"users": None, "properties": a, "purchases": b})
    assert sorted(r[0] for r in uni.collect()) == ["u1", "u2", "u3"]


def test_knn_exact_matches_brute_force(spark):
    import numpy as np
    from churnkit.operators.knn import knn_exact
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(f"p{i:03d}", *map(float, X[i])) for i in range(120)], "id string, a double, b double, c double")
    got = {}
    for r in knn_exact(df, "id", ["a", "b", "c"], 3, chunk_rows=10).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["n"]))
    for i in range(120):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [n for _, n in sorted(got[f"p{i:03d}"])] == [f"p{j:03d}" for j in np.argsort(d, kind="stable")[:3]]


def test_enn_and_adasyn_run(spark):
    rows = [(str(i), i % 2, float(i), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, y int, f1 double, f2 double")
    assert 0 < S.enn_clean(df, "y", ["f1", "f2"], "id", k=3).count() <= 40
    w = S.adasyn_counts(df, "y", ["f1", "f2"], "id", minority=1, k=3)
    assert abs(w.agg(F.sum("weight")).first()[0] - 1.0) < 1e-9


def test_categorical_cv_and_early_stopping(spark, data):
    d = data.withColumn("cat", F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))))
    oof = MD.categorical_cv(d, ["a", "b"], ["cat"], k=3, params={"numTrees": 5})
    assert oof.count() == 90
    m = MD.gbt_early_stopping(d.withColumn("yb", (F.col("y") > 0).cast("double")), ["a", "b", "c"], "yb",
                              valid_fold=0, params={"maxIter": 30})
    assert m.stages[-1].getNumTrees <= 30


def test_small_helpers(spark):
    from churnkit.functions.clean import align_columns, fill_numeric, make_labels, safe_features
    from churnkit.operators.blend import rank_runs
    from churnkit.plans.assemble import attach_labels
    a = spark.createDataFrame([(1, 0.2), (2, 0.6)], "user_id long, oof_s2 double")
    b = spark.createDataFrame([(1, 0.4), (2, 0.0)], "user_id long, oof_s2 double")
    v = {r[0]: r[1] for r in MD.soft_vote([a, b], [3.0, 1.0]).collect()}
    assert v[1] == pytest.approx(0.25) and v[2] == pytest.approx(0.45)
    runs = [spark.createDataFrame([(1, 0, 1, 0.2, 0.3, 0.5)], "user_id long, y int, fold int, p0 double, p1 double, p2 double"),
            spark.createDataFrame([(1, 0, 1, 0.4, 0.3, 0.3)], "user_id long, y int, fold int, p0 double, p1 double, p2 double")]
    assert MD.seed_average(runs).first()["p0"] == pytest.approx(0.3)
    m = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "user_id long, x double")
    imp = {r[0]: r[1] for r in S.median_impute(m, ["x"], key="user_id").collect()}
    assert imp[2] == 3.0
    lab = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2)], "user_id long, y int")
    assert S.pos_weight(lab.withColumn("y", (F.col("y") > 0).cast("int"))).first()[0] == pytest.approx(1 / 3)
    ml = {r["user_id"]: (r["y_churn"], r["y_invol"]) for r in make_labels(lab).collect()}
    assert ml[1] == (0, 0) and ml[2] == (1, 0) and ml[3] == (1, 1)
    al = align_columns(m, ["x", "missing"])
    assert al.columns == ["user_id", "x", "missing"] and al.where("missing = 0").count() == 4
    assert fill_numeric(m).where("x IS NULL").count() == 0
    assert safe_features(m, ["missing", "x"]) == ["x"]
    users = spark.createDataFrame([(1, "invol_churn"), (2, "not_churned")], "user_id long, churn_status string")
    assert {r["user_id"]: r["y"] for r in attach_labels(m, users).collect()}[1] == 2
    lb = rank_runs(spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.5)], "run string, f1 double"), "f1")
    assert [r[0] for r in lb.collect()] == ["c", "a", "b"]
