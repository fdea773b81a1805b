"""Schemas, column sets and the guards that operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

EPISODE_KEY = ["row_id", "task", "subject_id", "prediction_time", "label", "split"]
SPLITS = ["train", "tuning", "held_out"]

EVENTS = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("code", T.StringType()),
    T.StructField("omop_table", T.StringType()),
    T.StructField("numeric_value", T.FloatType()),
    T.StructField("text_value", T.StringType()),
])
SUBJECT_SPLITS = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("split", T.StringType()),
])
VOCAB = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("token_id", T.IntegerType()),
])

# The column names and special token ids that users' files carry.
EVENT_REQUIRED = ["subject_id", "time", "code", "omop_table"]
LABEL_CANDIDATES = [
    "boolean_value", "integer_value", "float_value", "categorical_value", "label", "value",
]
SPECIAL_TOKENS = {"<PAD>": 0, "<UNK>": 1, "<CLS>": 2}
LONG_PREDICTION = [
    "task", "model_family", "model_name", "representation", "compression_version", "numeric_on",
    "calibration", "seed", "split", "example_id", "subject_id", "y_true", "pred_proba",
]
WIDE_PREDICTION = [
    "task", "representation", "compression_version", "max_len", "era_gap", "model", "model_family",
    "numeric_on", "seed", "split", "row_id", "subject_id", "prediction_time", "y_true", "logit",
    "risk_raw", "risk_calibrated",
]
PERTURBED_REQUIRED = [
    "task", "compression_version", "requested_copy_fraction", "row_id", "subject_id", "y_true",
    "risk_calibrated",
]
AUDIT_CORE = [
    "source_type", "source_name", "task", "version", "time_rule", "row_id", "subject_id",
    "prediction_time", "label", "split", "path",
]
HISTORY_METRICS = [
    "earliest_retained_days_before_prediction", "covered_days", "final_seq_len",
    "n_backfill_events_added", "n_repeats_removed",
]
EPISODE_AUDIT_REQUIRED = [
    "original_history_len", "transformation_input_len", "transformed_history_len_before_truncation",
    "transformed_history_len", "final_seq_len", "n_repeats_removed",
    "n_visit_day_duplicates_removed", "n_era_repeat_mentions_removed",
    "n_net_events_removed_by_transform", "was_raw_window_truncated", "was_transformed_truncated",
    "was_truncated_by_max_len", "was_truncated", "earliest_retained_time", "latest_retained_time",
    "earliest_retained_days_before_prediction", "covered_days", "retained_calendar_span_days",
    "n_backfill_events_added", "n_unique_persistent_codes_full_history", "n_persistent_diagnoses",
    "n_persistent_events_original", "persistent_code_list_id", "persistent_code_list_sha256",
]


class DataContractError(ValueError):
    """A table breaks a contract an operator relies on."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataContractError(f"{what} lacks columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise DataContractError(f"{what} repeats the key {keys}")
    return df


def require_none(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fail when any row matches ``bad``; the scan stops at the first one."""
    if df.filter(bad).limit(1).count():
        raise DataContractError(message)
    return df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match, keeping the left keys only."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
