"""Promotion-code campaign sent to lists: revenue of all orders, of openers, of clickers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import at, contains_word
from ..operators import (
    Known,
    add_confirmed,
    by_click,
    by_list,
    campaign_metrics,
    flag_new,
    known_customers,
    new_customer_list,
    order_cells,
    source_breakdown,
)
from ..operators.attribution import list_weights
from .common import CELL, FLAGS, Company, Lines, campaign_spine, line_bundle
from .report import Keep, lazily


@dataclass(frozen=True)
class ListCampaign:
    """``start`` is the first day of the campaign and the cut-off for new customers."""

    start: str
    code_word: str
    source: str
    company: Company = field(default_factory=Company)
    lines: Lines = field(default_factory=Lines)


def list_campaign(
    orders: DataFrame,
    history: DataFrame | Known,
    touches: DataFrame,
    campaign_table: DataFrame,
    spec: ListCampaign,
    keep: Keep = lazily,
) -> dict[str, DataFrame]:
    """``orders`` are enriched; ``campaign_table`` names the lists in report order.

    ``history`` is the historical list, or first appearances that were found already. Metrics take cells.
    """
    start = at(spec.start)
    coded = orders.where(F.col("created_date") >= start).where(
        contains_word(F.col("promotion_code"), spec.code_word)
    )
    coded = add_confirmed(coded.withColumn("promotion_code", F.lower("promotion_code")), spec.lines.quote_lines)
    ready = keep("All Sources", coded)
    known = history if isinstance(history, Known) else known_customers(orders, history, before=start)
    opened = flag_new(by_list(ready, touches), known, cutoff=start)
    weights = list_weights(touches)
    weighed = ready.join(weights, ready["customer_email"] == weights["recipient"], "left")
    sources = {
        "All Sources": F.lit(1),
        "Open Email": F.coalesce("opened", F.lit(0)),
        "Open & Click": F.coalesce("clicks", F.lit(0)),
    }
    kept = keep("Open Email", opened)
    if kept is opened:  # nothing is read back: cells are labelled and flagged in place of orders
        cells = flag_new(by_list(order_cells(ready, CELL), touches), known, cutoff=start)
    else:
        cells = order_cells(kept, ["recent_open", *CELL, *FLAGS])
    return {
        "Open Email": kept,
        "All Sources": ready,
        "Open and Click": by_click(ready, touches),
        "Metrics": campaign_metrics(
            cells, line_bundle(spec.company, spec.lines), spine=campaign_spine(campaign_table), orders_col="orders"
        ),
        "Breakdown": source_breakdown(weighed, sources, spec.lines.breakdown, spec.lines.direct),
        "New Customers": new_customer_list(kept, F.lit(spec.source), spec.company.name),
    }
