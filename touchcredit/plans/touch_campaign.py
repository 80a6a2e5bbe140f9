"""Campaigns of several emails: every order is credited to the latest eligible email before it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import (
    Known,
    add_combined_name,
    add_confirmed,
    campaign_metrics,
    flag_new,
    known_customers,
    latest_touch,
    level_metrics,
    new_customer_list,
    one_level,
    order_cells,
    quote_measures,
    revenue_split_measures,
    spine_join,
)
from ..operators.attribution import credited, weigh_copies
from ..sources import campaign_groups
from .common import CELL, FLAGS, Company, Lines, campaign_spine, line_bundle, promo_bundle
from .report import Keep, lazily

#: Levels of the metrics with their keys.
LEVELS = {"campaign": "recent_open", "combined": "combined_email", "total": None}


@dataclass(frozen=True)
class TouchCampaign:
    """``by_line`` selects the bundle: split by line (research areas) or not (promotions).

    ``scope`` limits the orders that can be credited, not the orders that make a customer known.
    ``list_by_group`` names the roll-up in the customer list in place of the email. With ``keep_fanout`` an order
    counts in metrics as often as its touch was listed.
    """

    by_line: bool = False
    scope: Column | None = None
    confirm_by_line: bool = False
    with_detail: bool = False
    codes: tuple[str, ...] = ()
    list_by_group: bool = False
    keep_fanout: bool = False
    company: Company = field(default_factory=Company)
    lines: Lines = field(default_factory=Lines)

    @classmethod
    def promotion(cls, scope: Column, codes: tuple[str, ...] = (), company: Company = Company(), **changes) -> TouchCampaign:
        """Promotion emails: confirmation by status alone, detail of two lines, revenue by code."""
        return cls(scope=scope, codes=codes, with_detail=True, company=company, **changes)

    @classmethod
    def research_areas(cls, company: Company = Company(), **changes) -> TouchCampaign:
        """Research-area emails: all orders, all measures by line, customers listed by roll-up."""
        return cls(by_line=True, confirm_by_line=True, list_by_group=True, company=company, **changes)


def touch_campaign(
    orders: DataFrame,
    history: DataFrame | Known,
    touches: DataFrame,
    campaign_table: DataFrame,
    eligible: DataFrame,
    spec: TouchCampaign,
    keep: Keep = lazily,
) -> dict[str, DataFrame]:
    """``orders`` are enriched; ``eligible`` and ``campaign_table`` come from one index.

    The index's latest send date bounds the orders that can make a customer known. Metrics take cells: credited
    orders are reduced to customer, line, campaign and confirmation before they are flagged.
    """
    inside = orders if spec.scope is None else orders.where(spec.scope)
    complete = latest_touch(inside, touches, eligible, complete=True, keep_fanout=spec.keep_fanout)
    kept = keep("Labelled Complete", complete)
    if kept is complete:  # nothing is read back, so the credited orders alone are looked up
        credits = latest_touch(inside, touches, eligible, keep_fanout=spec.keep_fanout)
    else:
        credits = credited(kept)
    labelled = add_confirmed(credits, spec.lines.quote_lines if spec.confirm_by_line else None)
    if isinstance(history, Known):
        known = history
    else:
        latest = campaign_table.agg(F.max("sent_date")).scalar()
        known = known_customers(orders, history, before=latest)
    final = keep("Labelled", add_combined_name(flag_new(labelled, known, campaign_table), campaign_table))

    weighed = ["copies"] if spec.keep_fanout else []
    if kept is complete:  # cells are flagged in place of orders
        cells = order_cells(labelled, ["recent_open", *CELL, *weighed])
        cells = add_combined_name(flag_new(cells, known, campaign_table), campaign_table)
    else:
        labelled = final
        cells = order_cells(final, ["recent_open", *CELL, *FLAGS, "combined_email", *weighed])
    if weighed:
        cells = weigh_copies(cells)
        labelled = labelled.withColumn("billing_amount", F.col("billing_amount") * F.col("copies"))

    spine = campaign_spine(campaign_table)
    groups = campaign_groups(campaign_table).withColumnRenamed("combined_name", "combined_email")
    bundle = line_bundle(spec.company, spec.lines) if spec.by_line else promo_bundle(spec.company)
    source = F.col("combined_email" if spec.list_by_group else "recent_open")
    listed = ["recent_open", "customer_email", "email_lob", "lob", "user_name", "institution"]
    people = final
    if kept is complete:
        people = add_combined_name(flag_new(labelled.select(*listed).distinct(), known, campaign_table), campaign_table)
    # Campaigns, roll-ups and the total come from one pass; a single table that is asked for alone counts its own level.
    levels = level_metrics(cells, bundle, LEVELS, orders_col="orders")
    by_level = keep("Metrics by Level", levels)
    if by_level is levels:
        metrics = campaign_metrics(cells, bundle, spine=spine, orders_col="orders")
        combined = campaign_metrics(cells, bundle, key="combined_email", spine=groups, orders_col="orders")
    else:
        metrics = spine_join(one_level(by_level, "campaign", "recent_open"), spine)
        combined = spine_join(one_level(by_level, "combined", "combined_email"), groups, "combined_email")
    tables = {
        "Labelled Complete": kept,
        "Labelled": final,
        "Metrics by Level": by_level,
        "Metrics": metrics,
        "Metrics Combined": combined,
        "New Customers": new_customer_list(people, source, spec.company.name),
    }
    if not spec.by_line:
        tables["Revenue Breakdown"] = campaign_metrics(labelled, revenue_split_measures(), spine=spine)
    if spec.with_detail:
        detail = quote_measures(spec.lines.detail, count="Order")
        tables["Detail"] = campaign_metrics(cells, detail, spine=spine, orders_col="orders")
    if spec.codes:
        tables["Breakdown By Code"] = (
            labelled.where(F.col("promotion_code").isin(*spec.codes))
            .groupBy("promotion_code")
            .agg(F.sum("billing_amount").cast("double").alias("AllRevenue"))
        )
    return tables
