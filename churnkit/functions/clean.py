"""Cleaning projections C1-C24 as column expressions and DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .core import col_, encode_top_n, map_lookup, norm_lower


# C1 / C2 -------------------------------------------------------------------
def fix_year_1067(c) -> Column:
    """Leading ``1067-`` -> ``2023-`` on the raw string."""
    return F.regexp_replace(col_(c), r"^1067-", "2023-")


def any_year_to_2023(c) -> Column:
    """First four digits -> 2023 (profiling path)."""
    return F.regexp_replace(col_(c), r"^\d{4}", "2023")


# C3 / C4 -------------------------------------------------------------------
def drop_out_of_bounds(c) -> Column:
    """Year outside 1970..2100 -> NULL."""
    return F.when(F.year(col_(c)).between(1970, 2100), col_(c))


def parse_time(c) -> Column:
    """C1 + C4 (+C3): repair the year, parse as UTC timestamp, bad -> NULL.

    Accepts ``yyyy-MM-dd HH:mm:ss[.ffffff][+00:00]`` and ISO ``T`` forms."""
    s = F.regexp_replace(fix_year_1067(c), r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    ts = F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )
    return drop_out_of_bounds(ts)


# C5-C14 ---------------------------------------------------------------------
def plan_field(plan: Column, idx: int) -> Column:
    """Plan -> ordinal (0), monthly credits (1) or monthly cost (2)."""
    return map_lookup({k: v[idx] for k, v in cfg.PLAN_INFO.items()}, plan)


def normalize_country(c) -> Column:
    """C6."""
    return F.trim(F.upper(col_(c)))


def team_size_ordinal(c) -> Column:
    """Unknown (incl. NULL) -> 0."""
    return F.coalesce(map_lookup(cfg.TEAM_SIZE_ORDINAL, norm_lower(c)), F.lit(0)).cast("int")


def experience_ordinal(c) -> Column:
    """C11."""
    return F.coalesce(map_lookup(cfg.EXPERIENCE_ORDINAL, norm_lower(c)), F.lit(0)).cast("int")


def frustration_canon(c) -> Column:
    """lower/trim + canonical replace, NULL kept."""
    v = norm_lower(c)
    return F.coalesce(map_lookup(cfg.FRUSTRATION_CANON, v), v)


def source_norm(c) -> Column:
    """C13."""
    return norm_lower(c)


# Table cleaners ---------------------------------------------------------
def preprocess_properties(df: DataFrame) -> DataFrame:
    p = F.col("subscription_plan")
    return (df.withColumn("plan_ordinal", plan_field(p, 0).cast("double"))
              .withColumn("plan_monthly_credits", plan_field(p, 1).cast("double"))
              .withColumn("plan_monthly_cost_usd", plan_field(p, 2).cast("double"))
              .withColumn("country_code", normalize_country("country_code")))


def preprocess_generations(df: DataFrame) -> DataFrame:
    """C7, C8."""
    cost = F.col("credit_cost")
    gt = F.col("generation_type")
    return (df.withColumn("credit_cost_filled", F.coalesce(cost.cast("double"), F.lit(0.0)))
              .withColumn("is_free_model", cost.isNull() | (cost == 0))
              .withColumn("is_video", F.coalesce(gt.startswith("video_"), F.lit(False)))
              .withColumn("is_image", F.coalesce(gt.startswith("image_"), F.lit(False))))


def preprocess_transactions(df: DataFrame) -> DataFrame:
    """C9 + billing country normalisation."""
    return (df.withColumn("is_failed", F.col("failure_code").isNotNull())
              .withColumn("is_successful", F.col("failure_code").isNull())
              .withColumn("billing_address_country_norm", normalize_country("billing_address_country")))


def preprocess_quizzes(df: DataFrame) -> DataFrame:
    return (df.withColumn("team_size_ordinal", team_size_ordinal("team_size"))
              .withColumn("experience_ordinal", experience_ordinal("experience"))
              .withColumn("frustration_norm", frustration_canon("frustration"))
              .withColumn("source_norm", source_norm("source")))


def preprocess_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Apply every cleaner (tables already carry the logical schema)."""
    from ..sources.tables import conform
    out = dict(tables)
    out["properties"] = preprocess_properties(tables["properties"])
    out["generations"] = preprocess_generations(conform(tables["generations"], "generations"))
    out["transactions"] = preprocess_transactions(conform(tables["transactions"], "transactions"))
    out["quizzes"] = preprocess_quizzes(conform(tables["quizzes"], "quizzes"))
    out["purchases"] = conform(tables["purchases"], "purchases")
    return out


# C17: one quiz row per user -----------------------------------------------------
def dedupe_first(df: DataFrame, key: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """Keep the first row per key by a stable order (min over a struct: a partial
    aggregate, so a hot key never buffers its rows in one task)."""
    cols = [c for c in df.columns if c != key]
    order = order or cols
    s = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in cols])
    agg = df.groupBy(key).agg(F.min(s).alias("_s"))
    return agg.select(key, *[F.col(f"_s._v_{c}").alias(c) for c in cols])


# C19 / C20 labels ------------------------------------------------------------------
def make_labels(df: DataFrame, y: str = "y") -> DataFrame:
    """C20: binary churn and invol-given-churn labels from the 3-class label."""
    return (df.withColumn("y_churn", (F.col(y) > 0).cast("int"))
              .withColumn("y_invol", (F.col(y) == 2).cast("int")))


# C21 / C22 / C23 / C24 ----------------------------------------------------------------
def drop_noise(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in cfg.NOISE_COLUMNS if c in df.columns])


def safe_features(df: DataFrame, wanted: list[str]) -> list[str]:
    """Ordered intersection of wanted names with the frame's columns."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def fill_numeric(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Every numeric NULL -> value."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    return df.fillna(value, subset=num)


def align_columns(df: DataFrame, columns: list[str], key: str = "user_id") -> DataFrame:
    """Missing model columns -> 0, reordered to training order."""
    have = set(df.columns)
    return df.select(key, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])
