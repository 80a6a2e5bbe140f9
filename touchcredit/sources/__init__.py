"""Readers for the input tables.

Lists and history get lower-case keys here. Orders keep their case until `enrich_orders`, because the
rules for internal accounts are case-sensitive.
"""

from .folders import work_folder
from .headers import normalise_headers
from .index import campaign_groups, campaigns, eligibility, read_index
from .tables import read_history, read_orders, read_table, scan_orders, tidy_checked, tidy_history, tidy_orders
from .touches import read_open_list, read_touches, tidy_touches

__all__ = [
    "campaign_groups",
    "campaigns",
    "eligibility",
    "normalise_headers",
    "read_history",
    "read_index",
    "read_open_list",
    "read_orders",
    "read_table",
    "read_touches",
    "scan_orders",
    "tidy_checked",
    "tidy_history",
    "tidy_orders",
    "tidy_touches",
    "work_folder",
]
