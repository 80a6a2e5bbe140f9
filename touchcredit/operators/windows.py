"""Orders in the time windows of many campaigns at once.

Every campaign has its own start, length and scope. Time is cut into bins as long as a usual window; an order lies in one
bin, a window meets two or three. Windows and orders meet on the bin, the exact bounds are checked after it. So the work
grows with the orders and with what really overlaps, and the join is one on equal keys, whatever the number of campaigns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .attribution import list_members

#: A bin's orders are dealt to so many places where no list spreads them; the few windows are repeated for each.
PLACES = 32


def day_number(ts: Column) -> Column:
    """Days since 1970 on the clock the timestamp was written in."""
    return F.unix_date(F.to_date(ts))


def _bin(ts: Column, days: int) -> Column:
    return F.floor(day_number(ts) / days).cast("int")


def campaign_windows(campaign_table: DataFrame, days: int = C.WINDOW_DAYS, scopes: DataFrame | None = None) -> DataFrame:
    """``campaign, start, end, scope`` from the index: every campaign's window begins at its ``sent_date``.

    ``scopes`` (``campaign, value``) lists the values a campaign is limited to; a campaign without one takes all orders.
    The table may state its own ``days`` for each campaign. A campaign without a send date has no window.
    """
    length = F.coalesce("days", F.lit(days)) if "days" in campaign_table.columns else F.lit(days)
    out = campaign_table.where("sent_date IS NOT NULL").select(
        "campaign", F.col("sent_date").alias("start"), (F.col("sent_date") + F.make_dt_interval(length)).alias("end")
    )
    if scopes is None:
        return out.withColumn("scope", F.lit(None).cast("array<string>"))
    lists = scopes.where("value IS NOT NULL").groupBy("campaign").agg(F.collect_set("value").alias("scope"))
    return out.join(lists, "campaign", "left")


def _binned(windows: DataFrame, days: int) -> DataFrame:
    bins = F.sequence(_bin(F.col("start"), days), _bin(F.col("end"), days))
    return windows.where("start <= end").withColumn("__bin", F.explode(bins))


def _inside(scope_column: str | None) -> Column:
    within = (F.col("created_date") >= F.col("__start")) & (F.col("created_date") <= F.col("__end"))
    if scope_column is None:
        return within
    return within & (F.col("__scope").isNull() | F.coalesce(F.array_contains("__scope", F.col(scope_column)), F.lit(False)))


def _binned(windows: DataFrame, days: int) -> DataFrame:
    """A row for every bin that a window meets."""
    bins = F.sequence(_bin(F.col("start"), days), _bin(F.col("end"), days))
    named = windows.where("start <= end").withColumn("__bin", F.explode(bins))
    return named.withColumnsRenamed({"campaign": "recent_open", "start": "__start", "end": "__end", "scope": "__scope"})


def in_windows(
    orders: DataFrame, windows: DataFrame, scope_column: str | None = None, days: int = C.WINDOW_DAYS, places: int = PLACES
) -> DataFrame:
    """Orders with each campaign in whose window and scope they are, as ``recent_open``; both ends belong to a window.

    A month may hold most of the orders, so the orders of a bin are dealt to ``places`` by their customer and time.
    """
    spread = _binned(windows, days).withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    place = F.pmod(F.xxhash64("customer_email", "created_date"), F.lit(places)).cast("int")
    binned = orders.where("created_date IS NOT NULL").withColumns({"__bin": _bin(F.col("created_date"), days), "__place": place})
    joined = binned.drop("recent_open").join(spread, ["__bin", "__place"]).where(_inside(scope_column))
    return joined.select(*(c for c in orders.columns if c != "recent_open"), "recent_open")


def by_windows(
    orders: DataFrame,
    touches: DataFrame,
    windows: DataFrame,
    scope_column: str | None = None,
    days: int = C.WINDOW_DAYS,
    keep_fanout: bool = False,
) -> DataFrame:
    """Orders with each campaign on whose list their customer is, in its window and scope, as ``recent_open``.

    As one :func:`~touchcredit.operators.attribution.by_window` for every campaign, in one join on customer and bin: a
    large customer's orders are spread over the bins of their times. An order in the windows of two campaigns is two rows.
    The index's windows, a few rows for each mailed campaign, are read as one value, so that no list is placed by its
    campaign.
    """
    rows = F.struct("__bin", "__start", "__end", "__scope")
    per_campaign = _binned(windows, days).groupBy("recent_open").agg(F.collect_list(rows).alias("rows"))
    by_campaign = per_campaign.agg(F.map_from_entries(F.collect_list(F.struct("recent_open", "rows")))).scalar()
    members = list_members(touches, keep_fanout).where("recipient IS NOT NULL AND campaign IS NOT NULL")
    copies = ["copies"] if keep_fanout else []
    places = members.select(
        F.col("recipient").alias("__recipient"), F.col("campaign").alias("recent_open"), *copies,
        F.inline(F.element_at(by_campaign, F.col("campaign"))),
    )
    binned = orders.where("created_date IS NOT NULL").withColumn("__bin", _bin(F.col("created_date"), days))
    same = (binned["customer_email"] == places["__recipient"]) & (binned["__bin"] == places["__bin"])
    joined = binned.drop("recent_open").join(places, same).where(_inside(scope_column))
    return joined.select(*(c for c in orders.columns if c != "recent_open"), "recent_open", *copies)
