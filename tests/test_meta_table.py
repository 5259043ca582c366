"""The meta learner's passes read stored level-1 columns."""

from pyspark.sql import functions as F

from churnkit.plans import models as MD


def test_stack_reads_a_stored_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(MD, "multiclass_cv", lambda d, cols, **kw: seen.append((d, cols)) or d)
    base = spark.range(40).select(F.col("id").alias("user_id"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    level1 = [base.select("*", *[(F.rand(s) + i).alias(f"p{i}") for i in range(3)]) for s in (1, 2)]
    MD.stack(level1, ["a", "b"], 2)
    d, cols = seen[0]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" in plan
    assert cols == ["a_p0", "a_p1", "a_p2", "b_p0", "b_p1", "b_p2"] and d.count() == 40
    want = level1[0].join(level1[1].select("user_id", F.col("p2").alias("b_p2")), "user_id").select("user_id", "p0", "b_p2")
    assert sorted(map(tuple, d.select("user_id", "a_p0", "b_p2").collect())) == sorted(map(tuple, want.collect()))
