"""Predicates that state what happens to nulls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_in(col: Column, values: Iterable[str]) -> Column:
    """True unless ``col`` is one of ``values``; a null is kept.

    Written as ``IS NULL OR NOT IN`` and not with a coalesce, because this form reaches the Parquet scan.
    """
    values = list(values)
    return col.isNull() | ~col.isin(values) if values else F.lit(True)


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """Case-sensitive regular-expression match of any pattern; null stays null."""
    return col.rlike("|".join(f"(?:{p})" for p in patterns))


def not_matching(col: Column, patterns: Iterable[str]) -> Column:
    """True unless ``col`` matches one of ``patterns``; a null is kept."""
    patterns = list(patterns)
    return col.isNull() | ~matches_any(col, patterns) if patterns else F.lit(True)


def contains_word(col: Column, word: str) -> Column:
    """Case-insensitive substring test; null counts as no."""
    return F.coalesce(F.lower(col).contains(word.lower()), F.lit(False))
