"""Shape of report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def spine_join(metrics: DataFrame, spine: DataFrame, key: str = "recent_open") -> DataFrame:
    """Exactly the campaigns of ``spine`` (its ``key`` and ``pos``), in order; nulls where there is no row."""
    ordered = spine.select(key, F.col("pos").alias("__pos"))
    return ordered.join(metrics, key, "left").orderBy("__pos").drop("__pos")


def metric_rows(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Turn a one-row metric table into rows ``pos, metric, value``."""
    rows = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("metric"), F.col(f"`{name}`").cast("double").alias(value)
        )
        for i, name in enumerate(metrics.columns)
    ]
    return metrics.select(F.inline(F.array(*rows)))


def source_breakdown(
    orders: DataFrame,
    sources: Mapping[str, Column],
    quote: Mapping[str, str] = C.BREAKDOWN_QUOTE_LABELS,
    direct: Mapping[str, str] = C.DIRECT_LABELS,
) -> DataFrame:
    """Revenue by line and confirmation, one column per source, one row per metric.

    A source is a column saying how often the order counts in it (0 for not at all), so all sources come
    from one scan and one aggregation. Per quote-based line the rows are total, non-confirmed, confirmed;
    per direct line its revenue. A source without any order has nulls.
    """
    parts: list[tuple[str, Column]] = []
    for label, line in quote.items():
        for state, title in (("non_confirmed", "NonConfirmed"), ("confirmed", "Confirmed")):
            parts.append(
                (f"{label}_{title}Revenue", (F.col("lob_type") == line) & (F.col("confirmed") == state))
            )
    for label, line in direct.items():
        parts.append((f"{label}_Revenue", F.col("lob_type") == line))

    sums = []
    for s, weight in enumerate(sources.values()):
        for p, (_, when) in enumerate(parts):
            counted = F.when(when, F.col("billing_amount") * weight).otherwise(0)
            sums.append(F.sum(F.when(weight > 0, counted)).alias(f"s{s}p{p}"))
    one_row = orders.agg(*sums)

    place = {name: p for p, (name, _) in enumerate(parts)}
    metrics: list[tuple[str, list[int]]] = []
    for label in quote:
        open_, done = place[f"{label}_NonConfirmedRevenue"], place[f"{label}_ConfirmedRevenue"]
        metrics += [
            (f"{label}_Total", [open_, done]),
            (f"{label}_NonConfirmedRevenue", [open_]),
            (f"{label}_ConfirmedRevenue", [done]),
        ]
    metrics += [(f"{label}_Revenue", [place[f"{label}_Revenue"]]) for label in direct]

    def cell(s: int, ps: list[int]) -> Column:
        out = F.col(f"s{s}p{ps[0]}")
        for p in ps[1:]:
            out = out + F.col(f"s{s}p{p}")
        return out

    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(name).alias("metric"),
            *[cell(s, ps).cast("double").alias(title) for s, title in enumerate(sources)],
        )
        for i, (name, ps) in enumerate(metrics)
    ]
    return one_row.select(F.inline(F.array(*rows)))
