"""Raw export to orders ready for attribution."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame

from ..operators import CleaningRules, clean_stages
from ..operators.cleaning import fate_totals, observed, observed_totals, remap_lines
from .report import Keep, lazily


def cleaning_tables(raw: DataFrame, rules: CleaningRules, keep: Keep = lazily) -> dict[str, DataFrame]:
    """The three stages of cleaning, the rejects with their reasons, and orders and revenue by fate.

    The ready stage differs from the cleaned one in one column and is read from it where that is kept; the audit is then
    counted by the scan that writes it. Rejects are orders of real accounts: internal ones are left out there as well.
    """
    watched, watch = observed(raw, rules)
    stages = clean_stages(raw, rules)
    cleaned = stages["cleaned"]
    if keep is not lazily:
        cleaned = keep("Cleaned", clean_stages(watched, rules)["cleaned"])
        audit = raw.sparkSession.createDataFrame(
            [(fate, n, amount or Decimal(0)) for fate, n, amount in observed_totals(watch)], "fate string, orders bigint, revenue decimal(28,4)"
        )
    else:
        audit = fate_totals(raw, rules)
    return {
        "Raw": raw,
        "Cleaned": cleaned,
        "Ready": remap_lines(cleaned, rules.remapped_lines),
        "Rejects": stages["rejects"],
        "Audit": audit,
    }
