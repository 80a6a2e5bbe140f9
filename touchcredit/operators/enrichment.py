"""Derived columns and scope rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import confirmed, customer_key, line_code, quote_based


def enrich_orders(df: DataFrame, codes: Mapping[str, str] = C.LINE_CODES) -> DataFrame:
    """Add ``lob`` and ``email_lob`` and put the email in lower case."""
    return df.withColumn("lob", line_code(F.col("lob_type"), codes)).withColumns(
        {
            "email_lob": customer_key(F.col("customer_email"), F.col("lob")),
            "customer_email": F.lower("customer_email"),
        }
    )


def add_confirmed(
    df: DataFrame,
    quote_lines: Iterable[str] | None = C.QUOTE_LINES,
    open_statuses: Iterable[str] = C.NON_CONFIRMED_STATUSES,
) -> DataFrame:
    """Add ``quote_based`` and ``confirmed``; with ``quote_lines=None`` only the status decides."""
    status = F.col("order_status")
    if quote_lines is None:
        return df.withColumn("confirmed", confirmed(status, None, open_statuses))
    quote = quote_based(F.col("lob_type"), quote_lines)
    return df.withColumns({"quote_based": quote, "confirmed": confirmed(status, quote, open_statuses)})


def in_scope(
    priorities: Iterable[str],
    lines: Iterable[str] = C.SCOPE_LINES,
    priority_line: str = C.SCOPE_PRIORITY_LINE,
) -> Column:
    """Some lines wholly, one line only for certain priorities: one predicate, one pass."""
    line = F.col("lob_type")
    return line.isin(list(lines)) | ((line == priority_line) & F.col("priority").isin(list(priorities)))


def add_combined_name(labelled: DataFrame, campaign_table: DataFrame) -> DataFrame:
    """Add the roll-up name of each order's campaign as ``combined_email``; null where it has none."""
    names = campaign_table.select(
        F.col("campaign").alias("recent_open"), F.col("combined_name").alias("combined_email")
    )
    return labelled.join(names, "recent_open", "left")
