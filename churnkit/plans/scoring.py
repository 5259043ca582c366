"""Batch scoring of stored matrices under a saved contract.

A contract is a folder: the fitted pipelines (their fills, encoders and learner) and ``contract`` with the order of
the features and the class names.  Scoring a stored matrix adds columns that the matrix lacks as 0, ignores others,
and gives ``user_id, predicted_churn_status`` by the largest probability; it needs nothing but the folder.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..operators.inference import label_from_argmax
from ..operators.metrics import argmax3
from ..sources.tables import write_predictions
from .ensemble import Learner, Scorer, as_numbers, fit_scorer, spread
from .models import KEY

LABEL = "predicted_churn_status"


def save_contract(scorer: Scorer, features: list[str], path: str, spark: SparkSession, categoricals=(), meta: dict | None = None) -> None:
    """Writes the models first and the contract last, so a folder with a contract is whole."""
    for i, m in enumerate(scorer.models):
        m.write().overwrite().save(f"{path}/model-{i}")
    said = {"features": features, "categoricals": list(categoricals), "models": len(scorer.models), "classes": list(cfg.CLASS_NAMES), **(meta or {})}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_contract(spark: SparkSession, path: str) -> tuple[Scorer, dict]:
    said = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    return Scorer([PipelineModel.load(f"{path}/model-{i}") for i in range(said["models"])]), said


def train_contract(matrix: DataFrame, features: list[str], spec: Learner, path: str) -> None:
    """Fit on all labelled rows (``y``) and save."""
    save_contract(fit_scorer(matrix.where(F.col("y").isNotNull()), features, spec), features, path, matrix.sparkSession, spec.categoricals,
                  {"learner": spec.kind, "params": spec.params})


def score(matrix: DataFrame, path: str, probabilities: bool = False) -> DataFrame:
    """``user_id, predicted_churn_status`` (and ``p0, p1, p2``) of a matrix under a saved contract."""
    scorer, said = load_contract(matrix.sparkSession, path)
    lacking = {c: F.lit(0.0) for c in said["features"] if c not in matrix.columns}
    lacking |= {c: F.lit(None).cast("string") for c in said["categoricals"] if c not in matrix.columns}
    x = matrix.withColumns(lacking).select(KEY, *said["features"], *said["categoricals"])
    out = spread(scorer.apply(as_numbers(x, said["features"]), "_p"), "_p")
    out = out.withColumn("pred", argmax3(F.col("p0"), F.col("p1"), F.col("p2"))).withColumn(LABEL, label_from_argmax())
    return out.select(KEY, LABEL, *(["p0", "p1", "p2"] if probabilities else []))


def score_file(spark: SparkSession, matrix_path: str, contract_path: str, out_path: str) -> DataFrame:
    """Stored matrix in, two-column CSV out."""
    write_predictions(score(spark.read.parquet(matrix_path), contract_path), out_path, LABEL)
    return spark.read.option("header", True).csv(out_path)
