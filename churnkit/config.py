"""Fixed values the feature definitions depend on.

Everything in this module is a fixed value: plan metadata, top-N lists,
ordinal maps and thresholds.  They must equal the values the original
analysis used, otherwise feature values differ.  They are kept together,
as plain text, in their natural order.
"""

from __future__ import annotations

# --- fixed values: observation dates per split -----------------------------
OBSERVATION_DATES = {"train": "2023-11-25", "test": "2023-12-09"}

# --- fixed values: subscription plans (ordinal, monthly credits, monthly USD)
PLAN_INFO = {
    "Higgsfield Basic": (1, 1000, 9.0),
    "Higgsfield Pro": (2, 3000, 29.0),
    "Higgsfield Ultimate": (3, 7000, 49.0),
    "Higgsfield Creator": (4, 20000, 149.0),
    "Free": (0, 9000, 0.0),
}

# --- fixed values: plan tiers of the FE feature table
FE_PLAN_TIER = {"Higgsfield Creator": 0, "Higgsfield Basic": 1, "Higgsfield Pro": 2, "Higgsfield Ultimate": 3}

# --- fixed values: top-N category lists ------------------------------------
TOP_COUNTRIES = ["US", "IN", "DE", "JP", "GB", "FR", "KR", "BR", "TR", "IT",
                 "CA", "AU", "UA", "ES", "VN"]
TOP_SOURCES = ["instagram", "youtube", "friends", "other", "tiktok", "google",
               "ai-community", "chatgpt", "twitter"]
TOP_FIRST_FEATURES = [
    "Video Generations", "Commercial & Ad Videos", "Realistic AI Avatars",
    "Cinematic Visuals", "Viral Social Media Content", "Image Editing & Inpaint",
    "video-creation", "image-creation",
]

# --- fixed values: quiz ordinal / canonical maps ---------------------------
TEAM_SIZE_ORDINAL = {
    "solo": 1, "1": 1, "small": 2, "growing": 3, "2-10": 3,
    "midsize": 4, "11-50": 4, "501-2000": 5, "2001-5000": 5, "enterprise": 6,
}
EXPERIENCE_ORDINAL = {"beginner": 1, "intermediate": 2, "advanced": 3, "expert": 4}
FRUSTRATION_CANON = {
    "high cost of top models": "high-cost",
    "inconsistent results": "inconsistent",
    "limited generations": "limited",
}
SOURCE_INTENT = {
    "google": 2, "chatgpt": 2, "ai-community": 2,
    "youtube": 1, "friends": 1, "twitter": 1,
    "instagram": 0, "tiktok": 0,
}
COMMERCIAL_USAGE_PLANS = ["marketing", "filmmaking", "freelance", "education", "social"]
ROLE_COMMITMENT = {
    "just-for-fun": 0, "creator": 1, "designer": 1,
    "marketer": 2, "educator": 2, "prompt-engineer": 2,
    "filmmaker": 3, "brand-owner": 3,
    "founder": 4, "developer": 2,
}
QUIZ_FIELDS = ["source", "flow_type", "team_size", "experience", "usage_plan",
               "frustration", "first_feature", "role"]

# --- fixed values: generation / transaction thresholds ---------------------
BUSINESS_HOURS = (9, 18)          # inclusive hour range on weekdays
RECENT_WINDOW_DAYS = 14
ACTIVATION_WINDOW_DAYS = 7
LONG_WAIT_SECS = 300
HIGH_CREDIT_COST = 30
RETRY_WINDOW_HOURS = 24
TXN_RECENT_WINDOW_DAYS = 30
HIGH_VALUE_USD = 100

# --- fixed values: labels ---------------------------------------------------
LABELS = {"not_churned": 0, "vol_churn": 1, "invol_churn": 2}
CLASS_NAMES = ["not_churned", "vol_churn", "invol_churn"]

# --- fixed values: categorical columns label-encoded for tree learners -----
CATEGORICAL_COLUMNS = [
    "country_encoded", "dominant_generation_type", "dominant_aspect_ratio",
    "usage_plan_encoded", "role_encoded", "first_feature_encoded",
    "source_encoded", "card_funding_type", "dominant_failure_code",
    "dominant_card_brand",
]

# --- fixed values: columns dropped as noise in the v2 matrix ---------------
NOISE_COLUMNS = [
    "avg_processing_time_sec", "median_processing_time_sec", "pct_long_wait_gens",
    "dominant_usage_hour", "pct_gens_business_hours", "pct_gens_weekdays",
    "credit_cost_decimal", "inter_gen_regularity", "credit_regularity_score",
    "avg_gens_per_active_day", "n_credit_costing_gens",
]
