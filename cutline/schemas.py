"""Column contracts and closed value domains shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: keys of the observed cutoff table -------------------------------------
CHOICE_KEY = ["institute", "program", "category", "quota", "gender", "is_pwd"]
OUTCOME_KEY = CHOICE_KEY + ["round"]
STATIC_COLUMNS = ["institute_type", "duration_years", "degree_type"]
TARGET = "closing_rank"
REQUIRED_OBSERVED = ["year", *OUTCOME_KEY, *STATIC_COLUMNS, TARGET]
NATURAL_KEY = ["year", "round", "institute", "program", "quota", "category", "is_pwd", "gender"]
BRANCH_KEY = ["institute", "program", "category", "is_pwd", "gender", "quota"]
HISTORY_KEY = ["institute", "program", "category", "quota", "gender"]

# --- fixed values: closed domains ---------------------------------------------------------
CATEGORIES = ["OPEN", "OBC-NCL", "SC", "ST", "EWS"]
GENDERS = ["Gender-Neutral", "Female-only"]
QUOTAS = ["AI", "HS", "OS", "STATE"]
INSTITUTE_TYPES = ["IIT", "NIT", "IIIT", "GFTI"]
SORT_MODES = ["best_fit", "highest_probability", "most_competitive", "safest_backup"]
BUCKETS = ["safe_backup", "best_realistic", "ambitious_reach", "unlikely_reach"]
RANK_BANDS = ["1-5k", "5k-15k", "15k-50k", "50k-100k", "100k+"]
RANK_BAND_EDGES = [5_000, 15_000, 50_000, 100_000]
FIRST_EWS_YEAR = 2019
SEAT_CATEGORIES = [
    "OPEN", "OPEN-PWD", "GEN-EWS", "GEN-EWS-PWD", "SC",
    "SC-PWD", "ST", "ST-PWD", "OBC-NCL", "OBC-NCL-PWD",
]

# --- fixed values: what a forecast may look at --------------------------------------------
PRE_SEASON_FEATURES = [
    "year", "round", "duration_years", "is_pwd", "years_since_ews",
    "hist_mean_closing_rank", "hist_std_closing_rank", "hist_year_count",
    "last_closing_rank", "years_since_observed", "institute_freq", "program_freq",
    "institute_type", "institute", "program", "category", "quota", "gender", "degree_type",
]
PREVIOUS_ROUND_FEATURES = ["prev_round_closing_rank", "prev_round_number"]
FEATURES_BY_MODE = {
    "pre_counselling": PRE_SEASON_FEATURES,
    "in_round_update": PRE_SEASON_FEATURES + PREVIOUS_ROUND_FEATURES,
}
HISTORY_FEATURES = [
    "hist_mean_closing_rank", "hist_std_closing_rank", "hist_year_count",
    "last_closing_rank", "years_since_observed",
]
FREQUENCY_FEATURES = ["institute_freq", "program_freq"]
CATEGORICAL_FEATURES = [
    "institute_type", "institute", "program", "category", "quota", "gender", "degree_type",
]
OBSERVED_ONLY_COLUMNS = [
    "opening_rank", "closing_rank", "log_opening_rank", "log_closing_rank",
    "opening_percentile", "closing_percentile", "rank_spread", "competitiveness_ratio",
    "source_file", "source_row_id", "is_pwd_rank", "applicants",
]
UNIVERSE_FORBIDDEN = [
    "closing_rank", "opening_rank", "log_opening_rank", "opening_percentile",
    "applicants", "prev_round_closing_rank", "is_final_round",
]

RAW_ROUND_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "Institute", "Academic Program Name", "Quota", "Seat Type", "Gender",
        "Opening Rank", "Closing Rank",
    )]
)
LEGACY_ROUND_SCHEMA = T.StructType(
    [f for f in RAW_ROUND_SCHEMA.fields if f.name != "Gender"]
)


def check_features(names, mode: str) -> list[str]:
    """Return ``names`` if every one is allowed in ``mode``; a schema check, no Spark job."""
    if mode not in FEATURES_BY_MODE:
        raise ValueError(f"unknown feature mode {mode!r}; use one of {sorted(FEATURES_BY_MODE)}")
    refused = sorted(set(names) - set(FEATURES_BY_MODE[mode]))
    if refused:
        raise ValueError(f"features not available in {mode}: {refused}")
    return list(names)


def check_no_observed_columns(columns, forbidden=OBSERVED_ONLY_COLUMNS) -> None:
    leaked = sorted(set(columns) & set(forbidden))
    if leaked:
        raise ValueError(f"frame carries columns known only after the season: {leaked}")


def check_required(columns, required=REQUIRED_OBSERVED) -> None:
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
