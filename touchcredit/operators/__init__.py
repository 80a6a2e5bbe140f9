"""Transforms from DataFrames to DataFrames."""

from .attribution import by_click, by_list, by_window, latest_touch, touch_matrix
from .cleaning import CleaningRules, clean_orders, clean_stages
from .customer_sets import customer_sets, merge_sets, number_customers, set_sizes
from .enrichment import add_combined_name, add_confirmed, enrich_orders, in_scope
from .lists import new_customer_list
from .metrics import (
    Measure,
    acquired_measures,
    campaign_metrics,
    confirmed_measures,
    direct_measures,
    order_cells,
    quote_measures,
    revenue_split_measures,
    status_measures,
    total_measures,
    unique_measure,
)
from .newness import Known, first_appearances, flag_new, known_customers
from .prefilter import likely_members
from .reshape import metric_rows, source_breakdown, spine_join
from .rollups import level_metrics, one_level
from .windows import by_windows, campaign_windows, in_windows

__all__ = [
    "CleaningRules",
    "Known",
    "Measure",
    "acquired_measures",
    "add_combined_name",
    "add_confirmed",
    "by_click",
    "by_list",
    "by_window",
    "by_windows",
    "campaign_metrics",
    "campaign_windows",
    "clean_orders",
    "clean_stages",
    "confirmed_measures",
    "customer_sets",
    "direct_measures",
    "enrich_orders",
    "first_appearances",
    "flag_new",
    "in_scope",
    "in_windows",
    "known_customers",
    "latest_touch",
    "level_metrics",
    "likely_members",
    "merge_sets",
    "metric_rows",
    "new_customer_list",
    "number_customers",
    "one_level",
    "order_cells",
    "quote_measures",
    "revenue_split_measures",
    "set_sizes",
    "source_breakdown",
    "spine_join",
    "status_measures",
    "total_measures",
    "touch_matrix",
    "unique_measure",
]
