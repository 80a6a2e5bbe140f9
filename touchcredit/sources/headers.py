"""Header rules."""

from __future__ import annotations

from pyspark.sql import DataFrame


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case every column name and put ``_`` for a space."""
    return df.toDF(*[name.lower().replace(" ", "_") for name in df.columns])
