"""Registered queries against their DuckDB oracles on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

FAST = ["subscription_features_v1", "purchase_features_v1", "payment_features_v1", "quiz_features_v1",
        "payment_features_v2", "generation_features_v2", "generation_features_v1", "pr_curve_s1",
        "two_stage_metrics", "class_report", "joint_threshold_search", "blend_weight_search",
        "global_importance", "top_reasons", "intervention_mapping", "risk_histogram",
        "benford_leading_digits", "profile_describe_numeric", "stratified_folds", "class_weights"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, ocols)


def test_top_values_cover_every_logical_table(spark, con):
    from churnkit.sources.fixtures import VIEW_SQL
    rows = [r.asDict() for r in E.queries()["profile_top_values"](spark, SF).collect()]
    assert {r["table"] for r in rows} == set(VIEW_SQL)
    assert {r["value"] for r in rows if (r["table"], r["column"]) == ("generations", "status")} == {"failed", "nsfw", "canceled", "completed"}
    res = con.execute(E.oracle_sql()["profile_top_values"])
    cols = [d[0] for d in res.description]
    assert _digest([tuple(r[c] for c in cols) for r in rows], cols) == _digest(res.fetchall(), cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "final_label" in df.columns


def test_every_query_has_a_callable():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)


def test_country_codes_follow_the_nation_table(spark, tmp_path):
    """The code is the one of the nation's name, whatever its key; a key that the table lacks has none."""
    from churnkit.sources.fixtures import load_logical, view_ctes
    tables = {"customer": ("c_custkey long, c_nationkey int", [(1, 7), (2, 9), (3, 2), (4, 5), (50, 7)]),
              "nation": ("n_nationkey int, n_name string", [(7, "BRAZIL"), (9, "FRANCE"), (5, None)]),
              "events": ("user_id long, event_id long, event_type string, ts timestamp, value double", []),
              "labels": ("doc_id long, quality int, toxic int", [])}
    c = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {1: "BR", 2: "FR", 3: None, 4: None, 50: None}
    props = load_logical(spark, str(tmp_path))["properties"]
    assert {r["user_id"]: r["country_code"] for r in props.collect()} == want
    assert dict(c.execute(view_ctes("properties") + " SELECT user_id, country_code FROM properties").fetchall()) == want
