"""Whole reports: each takes tables and returns named tables, to be written by `write_report`."""

from .cleaning import cleaning_tables
from .common import Company, Lines
from .known_state import KnownState
from .list_campaign import ListCampaign, list_campaign
from .publish import Publication, overwrite_months, published
from .report import ReportFolder, write_report
from .touch_campaign import TouchCampaign, touch_campaign
from .window_campaign import WindowCampaign, WindowCampaigns, window_campaign, window_campaigns

__all__ = [
    "Company",
    "Lines",
    "Publication",
    "ReportFolder",
    "KnownState",
    "ListCampaign",
    "TouchCampaign",
    "WindowCampaign",
    "WindowCampaigns",
    "cleaning_tables",
    "list_campaign",
    "overwrite_months",
    "published",
    "touch_campaign",
    "window_campaign",
    "window_campaigns",
    "write_report",
]
