"""What the reports share."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import (
    Measure,
    acquired_measures,
    confirmed_measures,
    direct_measures,
    quote_measures,
    status_measures,
    unique_measure,
)

#: What identifies a cell: orders alike in these are one row in the joins and metrics of a report.
CUSTOMER_CELL = ("customer_email", "email_lob", "lob_type", "lob")
CELL = (*CUSTOMER_CELL, "confirmed")


#: What flagging adds to a cell.
FLAGS = ("new_to_company", "new_to_lob")


@dataclass(frozen=True)
class Company:
    """``name`` appears in customer types (``New to <name>``), ``short`` in columns (``NewTo<short>``)."""

    name: str = "Company"
    short: str = "Company"


@dataclass(frozen=True)
class Lines:
    """The lines of business with their labels in reports."""

    quote: Mapping[str, str] = field(default_factory=lambda: dict(C.QUOTE_LABELS))
    direct: Mapping[str, str] = field(default_factory=lambda: dict(C.DIRECT_LABELS))
    new: Mapping[str, str] = field(default_factory=lambda: dict(C.NEW_LINE_LABELS))
    breakdown: Mapping[str, str] = field(default_factory=lambda: dict(C.BREAKDOWN_QUOTE_LABELS))
    detail: Mapping[str, str] = field(default_factory=lambda: dict(C.DETAIL_LABELS))
    quote_lines: tuple[str, ...] = C.QUOTE_LINES


def line_bundle(company: Company, lines: Lines | None = None) -> list[Measure]:
    """All measures split by line of business: 49 columns."""
    lines = lines or Lines()
    return (
        quote_measures(lines.quote)
        + direct_measures(lines.direct)
        + status_measures(company.short, lines.new)
        + acquired_measures(company.short, lines.new)
        + unique_measure()
    )


def promo_bundle(company: Company) -> list[Measure]:
    """Measures without a split by line: 13 columns."""
    return (
        confirmed_measures()
        + status_measures(company.short, None)
        + acquired_measures(company.short, None)
        + unique_measure()
    )


def campaign_spine(campaign_table: DataFrame) -> DataFrame:
    return campaign_table.select(F.col("campaign").alias("recent_open"), "pos")
