"""VIF sweep, one-pass importance and weight search, scoring contract, tolerant reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators import blend as B
from churnkit.operators import sampling as S
from churnkit.operators.metrics import argmax3, summary_f1
from churnkit.plans import ensemble as E
from churnkit.plans import models as MD
from churnkit.plans import scoring as SC
from churnkit.sources import tables as TB


def vif_by_regression(x, threshold):
    keep = list(range(x.shape[1]))
    while len(keep) > 1:
        vif = []
        for j in keep:
            rest = x[:, [i for i in keep if i != j]]
            fit = rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
            vif.append((x[:, j] ** 2).sum() / max(((x[:, j] - fit) ** 2).sum(), 1e-12))
        j = int(np.argmax(vif))
        if vif[j] <= threshold:
            break
        keep.pop(j)
    return keep


def test_vif_is_the_uncentred_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) + np.array([5, 0, -3, 0, 1, 0])        # non-zero means count
    x[:, 3] = x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=200)
    cols = [f"f{j}" for j in range(6)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in cols)).repartition(4)
    for t in (3.0, 10.0, 1e6):
        assert S.vif_filter(df, cols, t) == [cols[j] for j in vif_by_regression(x, t)]
    # exact spans go first, from the first column on; zeros stay
    y = df.withColumns({"sum": F.col("f1") + F.col("f5"), "zero": F.lit(0.0)})
    assert S.vif_filter(y, ["f1", "f5", "sum", "zero"]) == ["f5", "sum", "zero"]


def test_importance_in_one_pass_equals_rescoring(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), *map(float, rng.normal(size=3))) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, y int, a double, b double, c double").withColumn("a", F.col("a") + F.col("y"))
    cols = ["a", "b", "c"]
    m = MD.final_fit(df, cols, "rf", {"numTrees": 5, "maxDepth": 4})
    got = {r["feature"]: r["importance"] for r in S.permutation_importance(m, df, cols, repeats=2).collect()}
    d = MD.prepare(df, cols)
    macro = lambda x: summary_f1(m.transform(x).withColumn("pred", F.col("prediction").cast("int")), "y", "pred").first()["macro_f1"]
    want = dict.fromkeys(cols, 0.0)
    for r in range(2):
        s = S.SEED + 1000 * r
        one = d.withColumn("_one", F.lit(0))
        a = S.rank_within_class(one, "_one", "user_id", s).select("user_id", "_pos")
        b = S.rank_within_class(one, "_one", "user_id", s + 1).select("_pos", *[F.col(c).alias(f"z_{c}") for c in cols])
        pairs = d.join(a, "user_id").join(b, "_pos")
        for c in cols:
            want[c] += (macro(d) - macro(pairs.withColumn(c, F.col(f"z_{c}")))) / 2
    assert got == pytest.approx(want)
    assert max(got, key=got.get) == "a"


@pytest.mark.parametrize("n", [2, 3])
def test_weight_search_equals_every_candidate(spark, n):
    rng = np.random.default_rng(n)
    p = rng.dirichlet([1, 1, 1], size=(120, n)).reshape(120, -1)
    names = [f"{m}{c}" for m in "abc"[:n] for c in range(3)]
    df = spark.createDataFrame([(int(rng.integers(0, 3)), *map(float, r)) for r in p], "y int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    models = [names[3 * m:3 * m + 3] for m in range(n)]
    cands = B.weight_candidates(n)
    scores = []
    for w in cands[:: max(1, len(cands) // 12)]:
        q = [sum(F.col(m[c]) * v for m, v in zip(models, w)) for c in range(3)]
        scores.append((w, summary_f1(df.withColumn("pred", argmax3(*q)), "y", "pred").first()["macro_f1"]))
    best = B.weight_grid_search(df, "y", models).first()
    assert best["macro_f1"] >= max(s for _, s in scores) - 1e-12
    counts = B.candidate_counts(df, "y", models, [w for w, _ in scores])
    per = {r["cand"]: r["n"] for r in counts.groupBy("cand").agg(F.sum("n").alias("n")).collect()}
    assert per == dict.fromkeys(range(len(scores)), 120)
    from churnkit.operators.metrics import macro_f1_of_counts
    assert {r["cand"]: r["macro_f1"] for r in macro_f1_of_counts(counts, ["cand"]).collect()} == pytest.approx({i: s for i, (_, s) in enumerate(scores)})


def test_contract_scores_a_stored_matrix(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), *map(float, rng.normal(size=2)), ["u", "v", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, y int, a double, b double, g string").withColumn("a", F.col("a") + 2 * F.col("y"))
    for spec in (E.Learner("f", "rf", {"numTrees": 4}, ("g",)), E.Learner("b", "gbt", {"maxIter": 2}), E.Learner("l", "lr")):
        path = f"{tmp_path}/{spec.name}"
        SC.train_contract(df, ["a", "b"], spec, path)
        scorer = E.fit_scorer(df, ["a", "b"], spec)
        want = {r["user_id"]: r["q"] for r in scorer.apply(E.as_numbers(df, ["a", "b"]), "q").collect()}
        got = SC.score(df.select("g", "b", "user_id", F.lit(1).alias("extra"), "a"), path, probabilities=True).collect()
        assert {r["user_id"]: [r["p0"], r["p1"], r["p2"]] for r in got} == {u: pytest.approx(list(p)) for u, p in want.items()}
        assert all(r[SC.LABEL] == ["not_churned", "vol_churn", "invol_churn"][int(np.argmax(want[r["user_id"]]))] for r in got)
    df.drop("b", "y").write.parquet(f"{tmp_path}/matrix")                   # b is lacking: 0
    out = SC.score_file(spark, f"{tmp_path}/matrix", f"{tmp_path}/l", f"{tmp_path}/out.csv")
    assert out.columns == ["user_id", SC.LABEL] and out.count() == 60


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_bad_records_are_quarantined_and_never_lost(spark, tmp_path):
    write(tmp_path / "train_users_purchases.csv",
          "extra,purchase_amount_dollars,user_id,purchase_time,transaction_id,purchase_type\n"
          "x,9.5,u1,1067-08-25 00:23:10+00:00,t1,Upsell\ny,nine,u2,2023-01-01 00:00:00,t2,Upsell\nz,3,u3,someday,t3,Gift\nz,,u4,,t4,Gift\n")
    df = TB.load_table(spark, str(tmp_path), "train_users", "purchases")
    rows = {r["user_id"]: r for r in df.collect()}
    assert df.columns == [c for c, _ in TB.SCHEMAS["purchases"]] and sorted(rows) == ["u1", "u2", "u3", "u4"]
    assert rows["u1"]["purchase_amount_dollars"] == 9.5 and rows["u1"]["purchase_time"].year == 2023
    assert rows["u2"]["purchase_amount_dollars"] is None and rows["u2"]["purchase_time"] is not None and rows["u3"]["purchase_time"] is None
    bad = TB.quarantine(spark, str(tmp_path), "train", str(tmp_path / "bad")).collect()
    assert sorted((r["table"], r["reason"]) for r in bad) == [("purchases", "bad time: purchase_time"), ("purchases", "malformed")]
    assert any("nine" in r["record"] for r in bad) and any("someday" in r["record"] for r in bad)


def test_builders_skip_missing_tables(spark, tmp_path):
    from churnkit.functions.clean import preprocess_all
    from churnkit.plans.assemble import build_feature_matrix, complete
    write(tmp_path / "test_users_purchases.csv", "user_id,transaction_id,purchase_time,purchase_type,purchase_amount_dollars\nu2,t1,2024-01-03 00:00:00,Upsell,5\n")
    write(tmp_path / "test_users_properties.csv", "user_id,subscription_start_date,subscription_plan,country_code\nu1,2024-01-01 00:00:00,Basic,US\n")
    tables = TB.load_available(spark, str(tmp_path), "test")
    assert tables["generations"] is None and sorted(r[0] for r in tables["users"].select("user_id").collect()) == ["u1", "u2"]
    have = {t: d for t, d in tables.items() if d is not None}
    clean = preprocess_all({**complete(have), **have})
    m = {r["user_id"]: r for r in build_feature_matrix(clean, "2024-01-31", version=1).collect()}
    assert sorted(m) == ["u1", "u2"] and m["u2"]["n_purchases_total"] == 1 and m["u1"]["country_encoded"] == "us" or m["u1"]["country_encoded"] == "US"
    with pytest.raises(FileNotFoundError):
        TB.load_available(spark, str(tmp_path), "train")


def test_permutation_pairs_rows_without_the_driver(spark, monkeypatch):
    """Rows meet their partners in merge joins, one repeat a job: no side of all rows is a broadcast, no plan grows with the repeats."""
    from churnkit import session
    df = spark.createDataFrame([(i, i % 2, float(i), float(i % 7)) for i in range(60)], "user_id long, y int, a double, b double")
    m = MD.final_fit(df, ["a", "b"], "rf", {"numTrees": 2, "maxDepth": 2})
    plans, keep = [], session.stored

    def seen(d, name="stored"):
        if name == "permuted":
            plans.append(d._jdf.queryExecution().executedPlan().toString())
        return keep(d, name)

    monkeypatch.setattr(session, "stored", seen)
    assert S.permutation_importance(m, df, ["a", "b"], repeats=3).count() == 2
    assert len(plans) == 3
    assert all(p.count("SortMergeJoin") >= 2 and "Union" not in p for p in plans)
