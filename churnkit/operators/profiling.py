"""Profiling (EDA) operators E1-E9 as single-pass DataFrame aggregations.

Column-wise statistics are computed in one aggregate over all columns
(``E2``) or over an unpivoted ``(column, value)`` table with the column
name as the grouping key (``E3``/``E4``), so adding columns never adds
scans, and per-column groups pre-aggregate map-side.  Exact quartiles
come from :func:`ordered.column_quantiles`, which ranks only the values around them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import column_quantiles

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table (one count job per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows",
                                                              F.lit(len(df.columns)).cast("long").alias("n_cols"))
             for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL count per column (one aggregate), columns with at least one NULL."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c))]).alias("column", "missing")
    return row.select(st).where(F.col("missing") > 0)


def _long(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast(cast))])
    return df.select(st.alias("column", "value"))


def describe(df: DataFrame) -> DataFrame:
    """E3 (numeric part): count, mean, std, min, 25%, 50%, 75%, max per numeric column.

    Quartiles are exact with linear interpolation; all columns share the scans."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[f(F.col(c).cast("double")).alias(f"{c}_{s}") for c in num for s, f in stats.items()])
    base = row.where("_rows > 0").select(F.stack(F.lit(len(num)), *[x for c in num for x in (F.lit(c), *[F.col(f"{c}_{s}") for s in stats])])
                                         .alias("column", *stats))
    q = column_quantiles(df, {c: F.col(c) for c in num}, [0.25, 0.5, 0.75])
    return base.join(q.select("column", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
                              F.col("q2").alias("p75")), "column", "left")


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E3 (categorical part): count, unique, top (most frequent, smallest on ties), freq."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    long = _long(df, cols, "string").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("_t"),
    ).select("column", "count", "unique", F.col("_t.v").alias("top"), (-F.col("_t.nn")).alias("freq"))


def top_values(df: DataFrame, k: int = 10, max_id_card: int = 50) -> DataFrame:
    """Top-k values per column including NULL (ties: smallest value first).

    Id-like columns with more than ``max_id_card`` distinct values are skipped, as in
    the original; each leaves one row ``(column, 'skipped', distinct values, NULL)``."""
    cols = df.columns
    long = _long(df, cols, "string")
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    card = vc.where(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("_card"))
    id_like = (F.coalesce(F.col("_card"), F.lit(0)) > max_id_card) & F.lower(F.col("column")).contains("id")
    skipped = card.where(id_like).select("column", F.lit("skipped").alias("value"), F.col("_card").alias("count"),
                                         F.lit(None).cast("long").alias("rank"))
    vc = vc.join(card, "column", "left").where(~id_like)
    from .ordered import top_k_per_key
    # a column may have many distinct values: salted two-round top-k per column
    top = top_k_per_key(vc.drop("_card"), "column", F.col("count"), F.col("value"), k)
    return top.withColumn("rank", F.col("rank").cast("long")).unionByName(skipped)


def class_share(df: DataFrame, col: str) -> DataFrame:
    """Counts and normalised shares of each value (NULLs excluded)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = vc.agg(F.sum("n").alias("_t"))
    return vc.crossJoin(F.broadcast(tot)).select(col, "n", (F.col("n") / F.col("_t")).alias("share"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Counts by one or two categories."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def mean_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``by``, sorted descending."""
    return df.groupBy(by).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc_nulls_last())


def bridge_user_matrix(users: DataFrame, props: DataFrame, quizzes: DataFrame, attempts: DataFrame,
                       purchases: DataFrame) -> DataFrame:
    """Attempts mapped to users through distinct (transaction_id, user_id)
    purchase pairs (inner), aggregated, joined to users with plan, country and quiz fields."""
    bridge = purchases.select("transaction_id", "user_id").distinct()
    mapped = attempts.drop("user_id").join(bridge, "transaction_id", "inner")
    agg = mapped.groupBy("user_id").agg(
        F.count("transaction_id").alias("total_attempts"),
        F.count("failure_code").alias("total_failed"),
        F.coalesce(F.sum("amount_in_usd"), F.lit(0.0)).cast("double").alias("amount_attempted"))
    agg = agg.withColumn("failure_rate", F.col("total_failed") / F.when(F.col("total_attempts") == 0, 1)
                         .otherwise(F.col("total_attempts")))
    out = (users.join(props.select("user_id", "subscription_plan", "country_code"), "user_id", "left")
                .join(quizzes.select("user_id", "experience", "team_size"), "user_id", "left")
                .join(agg, "user_id", "left"))
    return out.fillna(0, subset=["total_attempts", "total_failed", "amount_attempted", "failure_rate"])


def describe_basic(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, max of chosen columns (one unpivoted aggregate)."""
    long = _long(df, cols, "double")
    return long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
