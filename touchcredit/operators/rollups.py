"""Metrics of campaigns, of their roll-ups and of all orders from one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import Measure, measured

#: Name of the level over all rows; its key is null.
TOTAL = "total"


def level_metrics(
    labelled: DataFrame, measures: Sequence[Measure], levels: Mapping[str, str | None], orders_col: str | None = None
) -> DataFrame:
    """``level, key`` and all ``measures`` for every level, whose key is a column, or None for the total.

    Distinct customers of a roll-up are no sum of its campaigns'. So every row counts once at each level; rows meet only as
    marks and sums. Labelling, flagging and the pass over the orders are paid once for all levels. Rows with a null key are
    in no group of that level, but in the total.
    """
    groups = [
        {"level": F.lit(level), "key": (F.lit(None) if k is None else F.col(k)).cast("string")} for level, k in levels.items()
    ]
    out = measured(labelled, measures, groups, orders_col)
    return out.where(F.col("key").isNotNull() | F.col("level").isin([level for level, k in levels.items() if k is None]))


def one_level(metrics: DataFrame, level: str, key: str | None) -> DataFrame:
    """The rows of one level, with the key's own name."""
    rows = metrics.where(F.col("level") == level).drop("level")
    return rows.drop("key") if key is None else rows.withColumnRenamed("key", key)
