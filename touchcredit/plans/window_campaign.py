"""Lists with send dates: orders of their recipients in the days that follow, for one list or for a whole index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import at
from ..operators import (
    Known,
    acquired_measures,
    by_list,
    by_windows,
    campaign_metrics,
    campaign_windows,
    flag_new,
    known_customers,
    metric_rows,
    new_customer_list,
    order_cells,
    status_measures,
    total_measures,
    unique_measure,
)
from ..operators.attribution import in_window
from .common import CUSTOMER_CELL, FLAGS, Company, campaign_spine
from .report import Keep, lazily


@dataclass(frozen=True)
class WindowCampaign:
    """``scope`` is by line, by priority or by any other column of the orders."""

    sent_date: str
    scope: Column
    source: str
    days: int = C.WINDOW_DAYS
    company: Company = field(default_factory=Company)


def window_campaign(
    orders: DataFrame, history: DataFrame | Known, touches: DataFrame, spec: WindowCampaign, keep: Keep = lazily
) -> dict[str, DataFrame]:
    """``touches`` holds the one list; the send date also decides who is new."""
    start = at(spec.sent_date)
    known = history if isinstance(history, Known) else known_customers(orders, history, before=start)
    inside = in_window(orders, start, spec.days, spec.scope)
    labelled = flag_new(by_list(inside, touches), known, cutoff=start)
    kept = keep("Labelled", labelled)
    if kept is labelled:  # nothing is read back: cells are labelled and flagged in place of orders
        cells = flag_new(by_list(order_cells(inside, CUSTOMER_CELL), touches), known, cutoff=start)
    else:
        cells = order_cells(kept, [*CUSTOMER_CELL, *FLAGS])
    short = spec.company.short
    measures = total_measures() + status_measures(short, None) + acquired_measures(short, None) + unique_measure()
    metrics = campaign_metrics(cells, measures, key=None, orders_col="orders")
    return {
        "Labelled": kept,
        "Metrics": metrics,
        "Metric Rows": metric_rows(metrics),
        "New Customers": new_customer_list(kept, F.lit(spec.source), spec.company.name),
    }


@dataclass(frozen=True)
class WindowCampaigns:
    """``scope_column`` is what the campaigns' scopes are lists of: the line, the priority or any other column."""

    scope_column: str = "lob_type"
    days: int = C.WINDOW_DAYS
    company: Company = field(default_factory=Company)


def window_campaigns(
    orders: DataFrame,
    history: DataFrame | Known,
    touches: DataFrame,
    campaign_table: DataFrame,
    scopes: DataFrame | None,
    spec: WindowCampaigns,
    keep: Keep = lazily,
) -> dict[str, DataFrame]:
    """:func:`window_campaign` for every campaign of the index in one pass, each with its own send date and scope.

    ``scopes`` has ``campaign, value``; a campaign's send date also decides who is new to it.
    """
    if isinstance(history, Known):
        known = history
    else:
        known = known_customers(orders, history, before=campaign_table.agg(F.max("sent_date")).scalar())
    windows = campaign_windows(campaign_table, spec.days, scopes)
    inside = by_windows(orders, touches, windows, spec.scope_column, spec.days)
    labelled = flag_new(inside, known, campaign_table)
    kept = keep("Labelled", labelled)
    if kept is labelled:
        cells = flag_new(order_cells(inside, ["recent_open", *CUSTOMER_CELL]), known, campaign_table)
        listed = ["recent_open", "customer_email", "email_lob", "lob", "user_name", "institution"]
        people = flag_new(inside.select(*listed).distinct(), known, campaign_table)
    else:
        cells, people = order_cells(kept, ["recent_open", *CUSTOMER_CELL, *FLAGS]), kept
    short = spec.company.short
    measures = total_measures() + status_measures(short, None) + acquired_measures(short, None) + unique_measure()
    return {
        "Labelled": kept,
        "Metrics": campaign_metrics(cells, measures, spine=campaign_spine(campaign_table), orders_col="orders"),
        "New Customers": new_customer_list(people, F.col("recent_open"), spec.company.name),
    }
