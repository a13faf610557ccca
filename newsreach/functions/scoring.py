"""Scalar scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsreach import constants as K


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip01(value: Column | str) -> Column:
    """Limit a prediction to 0..1 (F8). A missing prediction (NULL or NaN) stays missing: NULL."""
    found = _col(value)
    return F.when(found.isNotNull() & ~F.isnan(found), F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def fill_category(value: Column | str) -> Column:
    """Missing category id as its own class."""
    return F.coalesce(_col(value), F.lit(K.MISSING_CATEGORY))


def log_score(value: Column | str, top: Column) -> Column:
    """``log1p(value) / log1p(top)``: 0..1 and not ruled by outliers."""
    return F.log1p(_col(value)) / F.log1p(top)


def rarity(total: Column | str, frequency: Column | str) -> Column:
    """Inverse document frequency ``ln(total / frequency)``."""
    return F.log(_col(total) / F.greatest(_col(frequency), F.lit(1)))


def match_bonus(left: Column | str, right: Column | str, weight: float, null_matches_null: bool = False) -> Column:
    """``weight`` where both sides agree, else 0 (C14).

    A missing value agrees with nothing. ``null_matches_null`` is the other convention in use, where
    missing values were filled with one class on both sides and therefore agree with each other.
    """
    left, right = _col(left), _col(right)
    same = left.eqNullSafe(right) if null_matches_null else F.coalesce(left == right, F.lit(False))
    return F.lit(weight) * same.cast("int")
