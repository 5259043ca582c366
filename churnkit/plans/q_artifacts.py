"""Registered artifact queries."""

from __future__ import annotations

from ..functions.core import round_doubles
from ..operators.artifacts import benford_report, build_artifact_features
from ..session import configure
from ..sources.fixtures import load_logical, read_driver


def q_artifact_features(spark, sf_dir):
    configure(spark)
    t = load_logical(spark, sf_dir)
    return round_doubles(build_artifact_features(t["users"], t["transactions"], t["purchases"]))


def q_benford(spark, sf_dir):
    configure(spark)
    return round_doubles(benford_report(read_driver(spark, sf_dir, "events"), "value"))


QUERIES = {"artifact_features": q_artifact_features, "benford_leading_digits": q_benford}
