"""Hand-made edge rows (FIXTURES.md section 3) against the exact null/zero rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnkit.functions.clean import parse_time, preprocess_generations, preprocess_transactions
from churnkit.functions.core import floor_days
from churnkit.operators import metrics as M
from churnkit.operators.artifacts import benford_prob, snap
from churnkit.operators.cross import add_composite_scores
from churnkit.operators.explain import map_to_intervention
from churnkit.operators.generations import build_generation_features
from churnkit.operators.tables_v1 import build_purchase_features, build_transaction_features
from churnkit.operators.tables_v2 import build_generation_features_v2, build_transaction_features_v2
from churnkit.sources.tables import conform

OBS = "2024-01-31"
T = dt.datetime


def gens(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, generation_id string, created_at timestamp, status string, "
                                     "credit_cost double, generation_type string")
    return preprocess_generations(conform(df, "generations"))


def props(spark, rows):
    return spark.createDataFrame(rows, "user_id string, subscription_start_date timestamp")


def one(df, uid, col):
    return df.where(F.col("user_id") == uid).first()[col]


def test_user_without_events(spark):
    p = props(spark, [("u0", T(2024, 1, 1)), ("u1", T(2024, 1, 1))])
    g = gens(spark, [("u1", "g1", T(2024, 1, 20), "completed", 2.0, "image_model_1")])
    out = build_generation_features(g, p, OBS)
    assert one(out, "u0", "total_generations") is None
    assert one(out, "u0", "credit_burn_rate") == 0.0
    assert one(out, "u0", "active_days_fraction") == 0.0
    v2 = build_generation_features_v2(g, p, OBS)
    assert one(v2, "u0", "trailing_silence_days") == 30
    assert one(v2, "u0", "max_gap_days_last_30") == 30


def test_recent_events_empty_prior_window(spark):
    p = props(spark, [("u", T(2023, 12, 1))])
    g = gens(spark, [("u", f"g{i}", T(2024, 1, 25, i), "completed", 1.0, "image_model_1") for i in range(3)])
    out = build_generation_features(g, p, OBS)
    assert one(out, "u", "gens_last_14_vs_prior_14") == 0.0


def test_one_event(spark):
    p = props(spark, [("u", T(2024, 1, 1))])
    g = gens(spark, [("u", "g1", T(2024, 1, 10), "completed", 1.0, "image_model_1")])
    out = build_generation_features(g, p, OBS)
    assert one(out, "u", "generation_frequency_cv") is None
    assert one(out, "u", "avg_inter_generation_hours") is None
    assert one(out, "u", "engagement_slope") == 0.0


def test_null_time_counts_as_latest(spark):
    p = props(spark, [("u", T(2024, 1, 1))])
    rows = [("u", f"g{i:02d}", T(2024, 1, 1 + i), "completed", 1.0, "image_model_1") for i in range(11)]
    rows.append(("u", "g99", None, "failed", 1.0, "image_model_1"))
    out = build_generation_features(gens(spark, rows), p, OBS, chunk_rows=3)
    assert one(out, "u", "failure_rate_last_10") == pytest.approx(0.1)


def test_mode_tie_smallest(spark):
    p = props(spark, [("u", T(2024, 1, 1))])
    g = gens(spark, [("u", "g1", T(2024, 1, 2), "completed", 1.0, "b"), ("u", "g2", T(2024, 1, 3), "completed", 1.0, "a")])
    assert one(build_generation_features(g, p, OBS), "u", "dominant_generation_type") == "a"


def test_event_after_observation_is_minus_one_day(spark):
    df = spark.createDataFrame([(T(2024, 1, 31), T(2024, 1, 31, 1))], "o timestamp, e timestamp")
    assert df.select(floor_days("o", "e").alias("d")).first()["d"] == -1


def txns(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, transaction_id string, transaction_time timestamp, "
                                     "amount_in_usd double, failure_code string")
    return preprocess_transactions(conform(df, "transactions"))


def test_failure_streak_and_only_failures(spark):
    rows = [("a", "1", T(2024, 1, 1), 10.0, "x"), ("a", "2", T(2024, 1, 2), 10.0, "x"),
            ("a", "3", T(2024, 1, 3), 10.0, None), ("a", "4", T(2024, 1, 4), 10.0, "x"),
            ("b", "5", T(2024, 1, 1), 10.0, "x"), ("c", "6", T(2024, 1, 1), 10.0, None)]
    t = txns(spark, rows)
    v2 = build_transaction_features_v2(t, OBS, chunk_rows=1)
    assert one(v2, "a", "n_consecutive_payment_failures") == 2
    assert one(v2, "b", "n_consecutive_payment_failures") == 1
    purch = spark.createDataFrame([("zz", "999")], "user_id string, transaction_id string")
    v1 = build_transaction_features(t, purch, OBS)
    assert one(v1, "b", "has_failed_but_no_successful_payment") == 1
    assert one(v1, "c", "has_failed_but_no_successful_payment") is None


def test_retry_exactly_24h(spark):
    t = txns(spark, [("a", "1", T(2024, 1, 1), 10.0, "x"), ("a", "2", T(2024, 1, 2), 10.0, "x")])
    purch = spark.createDataFrame([("zz", "999")], "user_id string, transaction_id string")
    assert one(build_transaction_features(t, purch, OBS), "a", "payment_retry_count") == 1


def test_business_hours(spark):
    p = props(spark, [("w", T(2024, 1, 1)), ("s", T(2024, 1, 1))])
    g = gens(spark, [("w", "g1", T(2024, 1, 10, 18), "completed", 1.0, "x"),   # Wednesday 18:00
                     ("s", "g2", T(2024, 1, 13, 18), "completed", 1.0, "x")])  # Saturday 18:00
    out = build_generation_features(g, p, OBS)
    assert one(out, "w", "pct_gens_business_hours") == 1.0
    assert one(out, "s", "pct_gens_business_hours") == 0.0


def test_quartile_duplicates(spark):
    vals = [1, 1, 2, 3, 4, 5, 6, 7]
    X = spark.createDataFrame([(f"u{i}", float(v)) for i, v in enumerate(vals)], "user_id string, generation_frequency_daily double")
    out = add_composite_scores(X, chunk_rows=3).orderBy("user_id")
    assert [r["rfm_frequency_bin"] for r in out.collect()] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_plan_change(spark):
    pu = spark.createDataFrame([("u", f"t{i}", T(2024, 1, 1 + i), "Subscription Update", a) for i, a in enumerate([10.0, 20.0, 20.0])],
                               "user_id string, transaction_id string, purchase_time timestamp, purchase_type string, purchase_amount_dollars double")
    out = build_purchase_features(pu, OBS)
    assert one(out, "u", "has_plan_upgrade") == 1
    assert one(out, "u", "has_plan_downgrade") is None


def test_raw_time_parsing(spark):
    df = spark.createDataFrame([("1067-08-25 00:23:10.133678+00:00",), ("junk",)], "s string")
    r = df.select(parse_time("s").alias("t")).collect()
    assert r[0]["t"] == T(2023, 8, 25, 0, 23, 10, 133678)
    assert r[1]["t"] is None


def test_snap_and_benford(spark):
    v = spark.createDataFrame([(str(i), x) for i, x in enumerate([9.0, 9.4, -1.0, 0.0, 9.5])], "id string, a double")
    anchors = spark.createDataFrame([(9.0,), (10.0,)], "anchor double")
    out = {r["id"]: r for r in snap(v, "a", anchors, "id", chunk_rows=2).withColumn("bf", benford_prob(F.col("a"))).collect()}
    assert [out[str(i)]["snap_val"] for i in range(4)] == [9.0, 9.0, 9.0, 9.0]
    assert out["4"]["snap_val"] == 10.0
    assert out["2"]["bf"] == 0.0 and out["3"]["bf"] == 0.0


def test_average_precision_edges(spark):
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert M.average_precision(perfect, "y", "s").first()[0] == pytest.approx(1.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)], "y int, s double")
    assert M.average_precision(tied, "y", "s").first()[0] == pytest.approx(0.25)


def test_hierarchical_to_3class(spark):
    df = spark.createDataFrame([(0.6, 0.25)], "pc double, pi double")
    r = df.select(*M.hierarchical_to_3class(F.col("pc"), F.col("pi"))).first()
    assert (r.p0, r.p1, r.p2) == pytest.approx((0.4, 0.45, 0.15))


def test_intervention_fallback(spark):
    reasons = spark.createDataFrame([("u", 1, f) for f in ["a", "b", "c", "d", "e"]], "user_id string, class int, feature string")
    r = map_to_intervention(reasons, spark).first()
    assert r["cluster"] == "engagement_decay"


def test_snap_over_several_chunks(spark):
    import churnkit.operators.artifacts as A
    v = spark.createDataFrame([(str(i), x) for i, x in enumerate([9.0, 9.4, -1.0, 0.0, 9.5, 12.0])], "id string, a double")
    anchors = spark.createDataFrame([(9.0,), (10.0,)], "anchor double")
    out = {r["id"]: r["snap_val"] for r in A.snap(v, "a", anchors, "id", chunk_rows=2).collect()}
    assert out == {"0": 9.0, "1": 9.0, "2": 9.0, "3": 9.0, "4": 10.0, "5": 10.0}


def test_fe_null_times_keep_null_frequency(spark):
    from churnkit.operators.fe_builder import fe_purchases
    pu = spark.createDataFrame([("u", "t1", None, "Upsell", 5.0), ("v", "t2", T(2024, 1, 2), "Upsell", 5.0)],
                               "user_id string, transaction_id string, purchase_time timestamp, purchase_type string, purchase_amount_dollars double")
    ref = spark.range(1).select(F.lit(1706659200000000).alias("_ref_us"))
    out = fe_purchases(pu, ref, ["Upsell"])
    assert one(out, "u", "purchase_frequency") is None
    assert one(out, "v", "purchase_frequency") == 1.0
