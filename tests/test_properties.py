"""Property checks: chunked plans equal plain plans; folds balanced; probabilities sum to 1."""

from pyspark.sql import functions as F

from churnkit.functions.clean import preprocess_all
from churnkit.operators.generations import build_generation_features
from churnkit.operators.sampling import assign_folds
from churnkit.sources.fixtures import FIXTURE_OBS_DATE, load_logical
from conftest import SF


def test_chunked_and_salted_plan_equals_plain(spark):
    t = preprocess_all(load_logical(spark, SF))
    a = build_generation_features(t["generations"], t["properties"], FIXTURE_OBS_DATE)
    b = build_generation_features(t["generations"], t["properties"], FIXTURE_OBS_DATE, chunk_rows=2)
    def norm(r):
        return repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    ra = sorted(map(norm, a.collect()))
    rb = sorted(map(norm, b.collect()))
    assert ra == rb


def test_fold_sizes_differ_by_at_most_one(spark):
    u = spark.range(0, 301).select(F.col("id").alias("user_id"), (F.col("id") % 3).cast("int").alias("y"))
    f = assign_folds(u, k=5).groupBy("y", "fold").count().collect()
    by = {}
    for r in f:
        by.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_status_counts_sum_to_total(spark):
    t = preprocess_all(load_logical(spark, SF))
    g = build_generation_features(t["generations"], t["properties"], FIXTURE_OBS_DATE).where("total_generations IS NOT NULL")
    bad = g.where(F.col("n_completed") + F.col("n_failed") + F.col("n_nsfw") + F.col("n_canceled")
                  + F.col("n_queued_or_waiting") != F.col("total_generations")).count()
    assert bad == 0


def test_chunks_have_equal_depth_for_any_distribution(spark):
    """Log-normal, mostly zero, constant and partly NULL order values of one hot key."""
    from churnkit.operators.ordered import ordered, with_chunks
    from churnkit.session import stored
    n, target = 20_000, 1_000
    base = spark.range(n).withColumn("k", F.lit(1))
    values = {"lognormal": F.exp(F.randn(1) * 3), "zeros": F.when(F.rand(2) < 0.6, 0.0).otherwise(F.rand(3)),
              "constant": F.lit(5.0), "nulls": F.when(F.rand(4) < 0.3, F.lit(None).cast("double")).otherwise(F.rand(5))}
    for v in values.values():
        df = stored(base.withColumn("v", v))  # random values are drawn once
        sizes = [r["count"] for r in with_chunks(df, "k", "v", "id", target).groupBy("_chunk").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * target
        marked = F.when(F.col("id") % 7 == 0, F.col("id"))
        got = ordered(df, "k", "v", "id", lags={"id": F.col("id")}, maxes_before={"m": marked}, mins_after={"m": marked}, chunk_rows=target)
        rows = sorted(got.collect(), key=lambda r: (r["v"] is None, r["v"] or 0.0, r["id"]))
        assert [r["_pos"] for r in rows] == list(range(1, n + 1))
        assert [r["_pos_desc"] for r in rows] == list(range(n, 0, -1))
        assert [r["lag_id"] for r in rows] == [None] + [r["id"] for r in rows[:-1]]
        ids = [r["id"] if r["id"] % 7 == 0 else None for r in rows]
        top, low, before, after = None, None, [], []
        for x, y in zip(ids, ids[::-1]):
            before.append(top)
            after.append(low)
            top = x if top is None or x is not None and x > top else top
            low = y if low is None or y is not None and y < low else low
        assert [r["maxbefore_m"] for r in rows] == before and [r["minafter_m"] for r in rows] == after[::-1]
