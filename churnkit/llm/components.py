"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` (the smallest node of the component) for the nodes of ``edges(a, b)``.

    Both steps are aggregates by node plus a join by node; the edges never grow in number.
    Stops when a round changes nothing.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(roots.select("node", F.col("node").alias("root")))
