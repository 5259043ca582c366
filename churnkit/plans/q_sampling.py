"""Registered split / fold / weight queries over the fixture users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_doubles
from ..operators import sampling as S
from ..session import configure
from ..sources.fixtures import load_logical


def _labelled(spark, sf_dir):
    configure(spark)
    u = load_logical(spark, sf_dir)["users"]
    y = F.element_at(F.create_map(F.lit("not_churned"), F.lit(0), F.lit("vol_churn"), F.lit(1),
                                  F.lit("invol_churn"), F.lit(2)), F.col("churn_status"))
    return u.select("user_id", y.cast("int").alias("y"))


def q_splits(spark, sf_dir):
    return S.make_splits(_labelled(spark, sf_dir)).select("user_id", "y", "split")


def q_holdout(spark, sf_dir):
    return S.make_holdout(_labelled(spark, sf_dir)).select("user_id", "y", "split")


def q_folds(spark, sf_dir):
    return S.assign_folds(_labelled(spark, sf_dir), k=5).select("user_id", "y", "fold")


def q_weights(spark, sf_dir):
    return round_doubles(S.class_weights(_labelled(spark, sf_dir)))


def _points(spark, sf_dir):
    """The embeddings, one column per dimension, ``y`` = 1 for label 0 (the minority) and 0 for the rest."""
    configure(spark)
    from ..sources.fixtures import read_driver
    e = read_driver(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    feats = [f"e{i}" for i in range(width)]
    d = e.select(F.col("vec_id").cast("string").alias("vec_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f)
                                                                     for i, f in enumerate(feats)],
                 (F.col("label") == 0).cast("int").alias("y"))
    return d, feats


def q_smote(spark, sf_dir):
    """M5 on the embeddings table (all dimensions, label 0 as minority vs the rest): one row per point
    with its vector; synthetic ones name their base, neighbour and gap."""
    d, feats = _points(spark, sf_dir)
    out = S.smote(d, "y", feats, "vec_id", k=5, origin=True)
    return out.select("vec_id", "y", "synthetic", "base", "neighbour", "gap", F.array(*feats).alias("vector"))


def q_adasyn(spark, sf_dir):
    """M6 on the embeddings table: one row per point with its vector; synthetic ones name base, neighbour and gap."""
    d, feats = _points(spark, sf_dir)
    out = S.adasyn(d, "y", feats, "vec_id", k=5, minority=1, origin=True)
    return out.select("vec_id", "y", "synthetic", "base", "neighbour", "gap", F.array(*feats).alias("vector"))


def q_adasyn_allocation(spark, sf_dir):
    """M6: how many synthetic rows each minority row gets, so that the classes become equal in number."""
    d, feats = _points(spark, sf_dir)
    n = d.agg(F.count_if(F.col("y") == 0).alias("rest"), F.count_if(F.col("y") == 1).alias("minority")).first()
    return S.adasyn_allocation(d, "y", feats, "vec_id", 1, max(0, n["rest"] - n["minority"]), k=5)


QUERIES = {
    "stratified_splits": q_splits,
    "holdout_split": q_holdout,
    "stratified_folds": q_folds,
    "class_weights": q_weights,
    "smote_oversample": q_smote,
    "adasyn_oversample": q_adasyn,
    "adasyn_allocation": q_adasyn_allocation,
}
