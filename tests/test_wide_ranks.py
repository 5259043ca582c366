"""Splits, folds and bins of wide frames: same ranks as narrow ones, without dealing out the wide rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.operators import sampling as S
from churnkit.operators.cross import add_composite_scores

EXTRA = [f"c{i}" for i in range(S.WIDE_COLUMNS)]


def _wide(df):
    return df.select("*", *[(F.col("user_id") * 7 + i).cast("double").alias(c) for i, c in enumerate(EXTRA)])


def test_wide_rows_get_the_ranks_of_narrow_ones(spark):
    df = spark.range(400).select(F.col("id").alias("user_id"), (F.col("id") % 3).cast("int").alias("y"))
    for k in (3, 5):
        narrow = {r["user_id"]: r["fold"] for r in S.assign_folds(df, k=k).collect()}
        got = S.assign_folds(_wide(df), k=k).collect()
        assert len(got) == 400
        assert {r["user_id"]: r["fold"] for r in got} == narrow
        assert all(r[c] == r["user_id"] * 7 + i for r in got for i, c in enumerate(EXTRA))
    narrow = {r["user_id"]: r["split"] for r in S.make_holdout(df).collect()}
    assert {r["user_id"]: r["split"] for r in S.make_holdout(_wide(df)).collect()} == narrow


def test_repeated_and_null_keys_are_ranked_one_by_one(spark):
    rows = [(i, i % 2) for i in range(40)] + [(7, 1)] * 5 + [(None, 0)] * 6 + [(8, 1), (9, None)]
    df = spark.createDataFrame(rows, "user_id long, y int")
    for d in (df, _wide(df)):
        got = S.rank_within_class(d, "y", "user_id").collect()
        for y in (0, 1):
            own = [r for r in got if r["y"] == y]
            n = sum(c == y for _, c in rows)
            assert sorted(r["_pos"] for r in own) == list(range(1, n + 1))
            assert {r["_n"] for r in own} == {n}
        assert sum(r["user_id"] is None for r in got) == 6
        assert {r["y"] for r in got} == {0, 1}


def test_wide_rows_are_not_stored_to_be_ranked(spark, monkeypatch):
    from churnkit.operators import ordered as O
    widths = []
    keep = O.stored
    monkeypatch.setattr(O, "stored", lambda df, *a: widths.append(len(df.columns)) or keep(df, *a))
    df = spark.range(50).select(F.col("id").alias("user_id"), (F.col("id") % 2).cast("int").alias("y"))
    assert S.assign_folds(_wide(df), k=2).count() == 50
    assert widths and max(widths) < S.WIDE_COLUMNS


def test_bin_edges_are_found_once(spark):
    vals = [None, 0.0, 1.0, 1.0, 2.0, 5.0, 9.0, float("nan")]
    df = spark.createDataFrame(list(enumerate(vals)), "user_id long, total_purchase_dollars double")
    out = add_composite_scores(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan.split("Join")[0]          # in the one-row table, not per row
    got = {r["user_id"]: r["rfm_monetary_bin"] for r in out.collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0, 5: 3.0, 6: 4.0, 7: 4.0}
