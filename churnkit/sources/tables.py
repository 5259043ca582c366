"""Sources and sinks for the six logical retention tables.

Raw tables arrive as CSV with string timestamps (some carry a bogus year
``1067``).  They are read with an explicit schema (no inference), time
strings are repaired on the string and parsed with ``try_to_timestamp``;
absent optional columns are added as typed NULLs so every operator sees
one stable schema.  Processed tables are written as Parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import parse_time

S, D, TS, B, L = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType(), T.LongType()

#: logical schemas (time columns typed TIMESTAMP after parsing)
SCHEMAS: dict[str, list[tuple[str, T.DataType]]] = {
    "users": [("user_id", S), ("churn_status", S)],
    "properties": [("user_id", S), ("subscription_start_date", TS), ("subscription_plan", S),
                   ("country_code", S)],
    "purchases": [("user_id", S), ("transaction_id", S), ("purchase_time", TS),
                  ("purchase_type", S), ("purchase_amount_dollars", D)],
    "quizzes": [("user_id", S), ("source", S), ("flow_type", S), ("team_size", S),
                ("experience", S), ("usage_plan", S), ("frustration", S),
                ("first_feature", S), ("role", S)],
    "transactions": [("transaction_id", S), ("user_id", S), ("transaction_time", TS),
                     ("amount_in_usd", D), ("billing_address_country", S),
                     ("card_3d_secure_support", S), ("card_brand", S), ("card_country", S),
                     ("card_funding", S), ("cvc_check", S), ("digital_wallet", S),
                     ("is_3d_secure", B), ("is_3d_secure_authenticated", B),
                     ("payment_method_type", S), ("bank_name", S), ("bank_country", S),
                     ("is_prepaid", D), ("is_virtual", D), ("is_business", D),
                     ("failure_code", S)],
    "generations": [("user_id", S), ("generation_id", S), ("created_at", TS),
                    ("completed_at", TS), ("failed_at", TS), ("status", S),
                    ("generation_type", S), ("resolution", S), ("credit_cost", D),
                    ("aspect_ration", S), ("duration", D), ("processing_time_sec", D)],
}

#: file suffix after the ``{split}_users`` prefix
TABLE_SUFFIX = {"users": "", "properties": "_properties", "purchases": "_purchases",
                "quizzes": "_quizzes", "transactions": "_transaction_attempts",
                "generations": "_generations"}

#: columns that may be missing from a split (added as NULL)
OPTIONAL = {"users": {"churn_status"}, "generations": {"processing_time_sec", "completed_at",
                                                      "failed_at", "aspect_ration", "duration",
                                                      "resolution"}}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add absent schema columns as typed NULLs; keep extra columns as they are."""
    have = set(df.columns)
    for name, dtype in SCHEMAS[table]:
        if name not in have:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def _csv_schema(table: str) -> T.StructType:
    # read every time column as a string first (repair happens before parsing)
    fields = [T.StructField(n, S if isinstance(t, T.TimestampType) else t, True)
              for n, t in SCHEMAS[table]]
    return T.StructType(fields)


#: column that holds a record the reader could not take as it is
_CORRUPT = "_record"


def read_tolerant(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """A CSV table bound to its schema, and its quarantine ``table, reason, record``.

    Only the header is looked at before; columns are taken by name in any order, absent ones are NULL, others are
    dropped.  A number or flag that does not parse is NULL, as is a time, and the record goes to the quarantine as well
    ("malformed", or "bad time: <column>"); a row is never lost and a bad one never ends the job."""
    types = dict(SCHEMAS[table])
    header = spark.read.option("header", True).csv(path).columns
    read = T.StructType([T.StructField(c, S if isinstance(types.get(c, S), T.TimestampType) else types.get(c, S)) for c in header]
                        + [T.StructField(_CORRUPT, S)])
    raw = (spark.read.schema(read).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
           .option("enforceSchema", True).csv(path))
    times = [c for c, t in SCHEMAS[table] if isinstance(t, T.TimestampType) and c in header]
    parsed = raw.withColumns({f"_t_{c}": parse_time(F.col(c)) for c in times})
    record = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*[F.col(f"`{c}`") for c in header])))
    reasons = [F.when(F.col(_CORRUPT).isNotNull(), F.lit("malformed"))]
    reasons += [F.when(F.col(f"_t_{c}").isNull() & (F.trim(c) != ""), F.lit(f"bad time: {c}")) for c in times]
    bad = (parsed.select(record.alias("record"), F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"))
           .select(F.lit(table).alias("table"), "reason", "record"))
    keep = [c for c, _ in SCHEMAS[table] if c in header]
    good = parsed.select(*[F.col(f"_t_{c}" if c in times else c).alias(c) for c in keep])
    return conform(good, table), bad


def load_table(spark: SparkSession, base: str, prefix: str, table: str,
               optional: bool = False) -> DataFrame | None:
    """Read one CSV table; ``None`` when an optional table is missing."""
    path = f"{base}/{prefix}{TABLE_SUFFIX[table]}.csv"
    if not _exists(spark, path):
        if optional:
            return None
        raise FileNotFoundError(path)
    return read_tolerant(spark, path, table)[0]


def quarantine(spark: SparkSession, base: str, split: str, path: str) -> DataFrame:
    """Writes the bad records of a split's tables to ``path`` and returns them."""
    found = [read_tolerant(spark, f, t)[1] for t, s in TABLE_SUFFIX.items() if _exists(spark, f := f"{base}/{split}_users{s}.csv")]
    schema = "table string, reason string, record string"
    out = found[0] if found else spark.createDataFrame([], schema)
    for d in found[1:]:
        out = out.unionByName(d)
    out.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def load_available(spark: SparkSession, base: str, split: str) -> dict[str, DataFrame | None]:
    """The tables that are there (others ``None``); without a users file the users are those of the other tables."""
    tables = {t: load_table(spark, base, f"{split}_users", t, optional=True) for t in TABLE_SUFFIX}
    if all(v is None for v in tables.values()):
        raise FileNotFoundError(f"{base}/{split}_users*.csv")
    if tables["users"] is None:
        tables["users"] = conform(user_universe(tables), "users")
    return tables


def load_split(spark: SparkSession, base: str, split: str) -> dict[str, DataFrame]:
    """The six tables of a split."""
    prefix = f"{split}_users"
    return {t: load_table(spark, base, prefix, t) for t in TABLE_SUFFIX}


def user_universe(tables: dict[str, DataFrame]) -> DataFrame:
    """Users file if present, else the union of user ids over the other tables."""
    if tables.get("users") is not None:
        return tables["users"].select("user_id").distinct()
    parts = [tables[t].select("user_id") for t in
             ("properties", "purchases", "quizzes", "transactions", "generations")
             if tables.get(t) is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("user_id").isNotNull()).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet (default) or CSV by suffix."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.endswith(".csv"):
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_through(spark: SparkSession, path: str, build, force_rebuild: bool = False) -> DataFrame:
    """Reuse a processed table if it exists, else build and write it."""
    if not force_rebuild and _exists(spark, path):
        return spark.read.parquet(path)
    df = build()
    write_table(df, path)
    return spark.read.parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append metric rows."""
    df.write.mode("append").parquet(path)


def save_oof(df: DataFrame, path: str, run: str) -> None:
    """Out-of-fold probabilities ``(user_id, p0, p1, p2)`` partitioned by run."""
    (df.withColumn("run", F.lit(run)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def load_oof(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run") == run).drop("run")


def write_predictions(df: DataFrame, path: str, label_col: str = "predicted_label") -> None:
    """Two-column prediction CSV."""
    df.select("user_id", label_col).write.mode("overwrite").option("header", True).csv(path)
