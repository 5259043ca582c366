"""Quartiles of whole columns: equal to the full ranking, but only values around them are ranked."""

import math

from pyspark.sql import functions as F

from churnkit.operators import ordered as O
from churnkit.operators import profiling as P


def _table(spark, n):
    return spark.range(n).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(10 ** 9)) / 7).alias("a"),
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 100 < 90, 0.0).otherwise(F.col("id") % 7)).alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("c"),
        F.lit(None).cast("double").alias("z"))


def test_quantiles_of_whole_columns_equal_the_ranking(spark):
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for n in (0, 1, 2, 7, 1500, 20_000):
        df = _table(spark, n)
        got = {r[0]: r[1:] for r in O.column_quantiles(df, {c: F.col(c) for c in "abcz"}, qs).collect()}
        long = df.select("id", F.expr("stack(4, 'a', a, 'b', b, 'c', c, 'z', z) AS (m, v)"))
        want = {r[0]: r[1:] for r in O.exact_quantiles(long, "v", qs, keys=["m"], tie="id").collect()}
        assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_describe_ranks_only_values_around_the_quartiles(spark, monkeypatch):
    ranked, plain = [], O.ordered

    def counted(df, *args, **kw):
        ranked.append(df.count())
        return plain(df, *args, **kw)

    monkeypatch.setattr(O, "ordered", counted)
    rows = {r["column"]: r for r in P.describe(_table(spark, 20_000).select("id", "a", "b", "z")).collect()}
    assert sum(ranked) < 2_000
    assert (rows["id"]["p25"], rows["id"]["p50"], rows["id"]["p75"]) == (4999.75, 9999.5, 14999.25)
    assert (rows["id"]["count"], rows["id"]["min"], rows["id"]["max"]) == (20_000, 0.0, 19_999.0)
    assert (rows["z"]["count"], rows["z"]["p50"]) == (0, None) and math.isclose(rows["id"]["mean"], 9999.5)
    assert P.describe(_table(spark, 0).select("id", "a")).count() == 0
