"""Scalar column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole_days(earlier, later) -> Column:
    """Whole days between two timestamps, cut toward zero (not calendar days)."""
    return F.timestamp_diff("DAY", _c(earlier), _c(later))


def whole_hours(earlier, later) -> Column:
    return F.timestamp_diff("HOUR", _c(earlier), _c(later))


def fractional_days(earlier, later) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(86400e6)


def event_day(t) -> Column:
    return F.date_format(_c(t), "yyyy-MM-dd")


def count_bin(n) -> Column:
    # The bin labels are part of token names.
    n = _c(n)
    return (
        F.when(n <= 1, "1").when(n == 2, "2").when(n <= 5, "3_5").when(n <= 10, "6_10")
        .otherwise("gt10")
    )


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -30.0, 30.0)))


def logit(p, eps: float = 1e-8) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def copy_order_hash(seed: int, *parts) -> Column:
    """Stable hex digest of ``seed|part|...``; its order is the unsigned order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]), 256)


def blake2b_hash(seed: int, *parts) -> Column:
    """The 8-byte BLAKE2b variant of :func:`copy_order_hash`, as 16 hex digits."""
    @F.pandas_udf("string")
    def digest(payload: pd.Series) -> pd.Series:
        return payload.map(
            lambda s: None if s is None else hashlib.blake2b(s.encode(), digest_size=8).hexdigest()
        )

    return digest(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


def direction_label(x, tol: float = 1e-12) -> Column:
    x = _c(x)
    return F.when(x > tol, "model_a_better").when(x < -tol, "model_b_better").otherwise("equal")


def saturating(x, half: float = 365.0) -> Column:
    x = _c(x)
    return x / (x + F.lit(half))


def safe_ratio(num, den) -> Column:
    return _c(num) / F.greatest(_c(den), F.lit(1))


def ceil_fraction(n, frac) -> Column:
    return F.ceil(_c(n) * _c(frac)).cast("long")


def null_safe_eq(a, b) -> Column:
    """NULL equals NULL and NaN equals NaN."""
    return _c(a).eqNullSafe(_c(b))


def is_finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def safe_bool(x) -> Column:
    return F.coalesce(
        F.lower(F.trim(_c(x).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False)
    )


def normalize_label(x) -> Column:
    """0/1 from boolean, numeric or text labels; NULL for everything else, also NaN and other numbers."""
    text = F.lower(F.trim(_c(x).cast("string")))
    number = text.try_cast("double")
    return F.when(text.isin("true", "yes") | (number == 1), 1).when(text.isin("false", "no") | (number == 0), 0).cast("int")


def era_prefix(gap_days: int) -> str:
    return f"DX_ERA{int(gap_days)}"


def structural_pattern(gap_days: int) -> str:
    return f"^{era_prefix(gap_days)}_(START|END|COUNT_BIN)/"


def strip_structure(code, gap_days: int) -> Column:
    """The base code behind a START, END or COUNT_BIN token."""
    p = era_prefix(gap_days)
    return F.regexp_replace(_c(code), f"^{p}_(START/|END/|COUNT_BIN/[^/]+/)", "")


def era_gap_of(version) -> Column:
    found = F.regexp_extract(_c(version), r"condition_era_(\d+)_", 1)
    return F.when(found != "", found.cast("int"))
