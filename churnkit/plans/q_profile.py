"""Registered profiling queries (driver tables and fixture views)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.core import round_doubles
from ..operators import profiling as P
from ..session import configure
from ..sources.fixtures import VIEW_SQL, load_logical, read_driver

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: all numeric columns per driver table
NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
#: all text columns per driver table, but for free text
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type"], "documents": ["lang", "source"],
    "pages": ["url"], "conversations": ["role"],
}
TOP_TABLES = list(VIEW_SQL)


def q_shape(spark, sf_dir):
    configure(spark)
    return P.shape({t: read_driver(spark, sf_dir, t) for t in DRIVER_TABLES})


def q_missing(spark, sf_dir):
    configure(spark)
    parts = [P.missing_counts(df).select(F.lit(t).alias("table"), "column", "missing")
             for t, df in load_logical(spark, sf_dir).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def q_describe_numeric(spark, sf_dir):
    configure(spark)
    parts = []
    for t, cols in NUMBERS.items():
        df = read_driver(spark, sf_dir, t).select(*cols)
        parts.append(P.describe(df).withColumn("table", F.lit(t)))
    return round_doubles(reduce(lambda a, b: a.unionByName(b), parts))


def q_describe_categorical(spark, sf_dir):
    configure(spark)
    parts = [P.describe_categorical(read_driver(spark, sf_dir, t), cols).withColumn("table", F.lit(t))
             for t, cols in TEXT_COLUMNS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def q_top_values(spark, sf_dir):
    configure(spark)
    t = load_logical(spark, sf_dir)
    parts = [P.top_values(t[n]).withColumn("table", F.lit(n)) for n in TOP_TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


def q_class_share(spark, sf_dir):
    configure(spark)
    return round_doubles(P.class_share(load_logical(spark, sf_dir)["users"], "churn_status"))


def q_counts_by(spark, sf_dir):
    configure(spark)
    return P.counts_by(read_driver(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def q_mean_by(spark, sf_dir):
    configure(spark)
    return round_doubles(P.mean_by(load_logical(spark, sf_dir)["generations"], "generation_type", "duration"))


def q_bridge(spark, sf_dir):
    configure(spark)
    t = load_logical(spark, sf_dir)
    return round_doubles(P.bridge_user_matrix(t["users"], t["properties"], t["quizzes"], t["transactions"],
                                              t["purchases"]))


QUERIES = {
    "profile_shape": q_shape,
    "profile_missing": q_missing,
    "profile_describe_numeric": q_describe_numeric,
    "profile_describe_categorical": q_describe_categorical,
    "profile_top_values": q_top_values,
    "profile_class_share": q_class_share,
    "profile_counts_by": q_counts_by,
    "profile_mean_by": q_mean_by,
    "profile_bridge_matrix": q_bridge,
}
