"""Command line: ``touchcredit_job.py <report> <settings.json>`` under ``spark-submit``.

Settings name the input paths, the output folder and the campaign's parameters; see the README.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.amounts import AMOUNT_TYPE
from .operators import CleaningRules, enrich_orders, in_scope
from .plans import (
    Company,
    ListCampaign,
    Publication,
    ReportFolder,
    TouchCampaign,
    WindowCampaign,
    cleaning_tables,
    list_campaign,
    touch_campaign,
    window_campaign,
    write_report,
)
from .plans.report import Keep, lazily
from .sources import (
    campaigns,
    eligibility,
    read_history,
    read_index,
    read_open_list,
    read_orders,
    read_table,
    read_touches,
    scan_orders,
    tidy_checked,
)

#: Settings of a session that runs reports; what a cluster sets itself is left alone.
SESSION = {
    # Above this size the JVM leaves a generated method uncompiled; per-expression code is faster then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}
REQUIRED = {
    "clean": ("orders", "out"),
    "list": ("orders", "history", "index", "lists", "out", "start", "code_word", "source"),
    "touch": ("orders", "history", "index", "lists", "out"),
    "window": ("orders", "history", "list", "out", "sent_date", "scope_values", "source"),
}


def checked(report: str, s: dict) -> dict:
    """The settings, or an error that names all that are missing."""
    needed = list(REQUIRED[report])
    if report == "touch" and s.get("kind", "promotion") == "promotion":
        needed.append("priorities")
    missing = [name for name in needed if name not in s]
    if missing:
        raise ValueError(f"settings of the {report} report lack: {', '.join(missing)}")
    return s


def _orders(spark: SparkSession, s: dict) -> DataFrame:
    orders = read_orders(spark, s["orders"], s.get("format", "parquet"))
    return enrich_orders(orders.withColumn("billing_amount", F.col("billing_amount").cast(AMOUNT_TYPE)))


def _history(spark: SparkSession, s: dict) -> DataFrame:
    return read_history(spark, s["history"], s.get("format", "parquet"))


def run_clean(spark: SparkSession, s: dict, keep: Keep = lazily) -> dict[str, DataFrame]:
    changes = {"converted_rate": s["rate"]} if "rate" in s else {}
    rules = CleaningRules.for_company(s["company"], **changes) if "company" in s else CleaningRules(**changes)
    if "columns" in s:  # an export with declared columns: rows of the wrong shape are rejects
        raw = scan_orders(spark, s["orders"], s["columns"])
    else:
        raw = tidy_checked(read_table(spark, s["orders"], s.get("format", "parquet")))
    return cleaning_tables(raw, rules, keep)


def run_list(spark: SparkSession, s: dict, keep: Keep = lazily) -> dict[str, DataFrame]:
    table = campaigns(read_index(spark, s["index"], s.get("index_format", "csv")))
    touches = read_touches(spark, s["lists"], table, s.get("list_format", "csv"))
    spec = ListCampaign(s["start"], s["code_word"], s["source"], Company(**s.get("company", {})))
    return list_campaign(_orders(spark, s), _history(spark, s), touches, table, spec, keep)


def run_touch(spark: SparkSession, s: dict, keep: Keep = lazily) -> dict[str, DataFrame]:
    index = read_index(spark, s["index"], s.get("index_format", "csv"))
    table = campaigns(index, s.get("groups"))
    touches = read_touches(spark, s["lists"], table, s.get("list_format", "csv"))
    company = Company(**s.get("company", {}))
    if s.get("kind", "promotion") == "promotion":
        codes = tuple(s.get("codes", ()))
        spec = TouchCampaign.promotion(in_scope(s["priorities"]), codes, company, keep_fanout=s.get("keep_fanout", False))
    else:
        spec = TouchCampaign.research_areas(company, keep_fanout=s.get("keep_fanout", False))
    return touch_campaign(_orders(spark, s), _history(spark, s), touches, table, eligibility(index), spec, keep)


def run_window(spark: SparkSession, s: dict, keep: Keep = lazily) -> dict[str, DataFrame]:
    touches = read_open_list(spark, s["list"], s["source"], s.get("list_format", "csv"))
    scope = F.col(s.get("scope_column", "lob_type")).isin(*s["scope_values"])
    spec = WindowCampaign(s["sent_date"], scope, s["source"], company=Company(**s.get("company", {})))
    return window_campaign(_orders(spark, s), _history(spark, s), touches, spec, keep)


REPORTS = {"clean": run_clean, "list": run_list, "touch": run_touch, "window": run_window}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("report", choices=sorted(REPORTS))
    parser.add_argument("settings", help="path of a JSON file")
    args = parser.parse_args(argv)
    with open(args.settings, encoding="utf-8") as f:
        settings = checked(args.report, json.load(f))
    spark = SparkSession.builder.appName(f"touchcredit-{args.report}").config(map=SESSION).getOrCreate()
    if settings.get("publish"):
        run = Publication(spark, settings["out"], settings.get("out_format", "parquet"))
        run.publish(REPORTS[args.report](spark, settings, run.keep))
        return
    folder = ReportFolder(settings["out"], settings.get("out_format", "parquet"))
    tables = REPORTS[args.report](spark, settings, folder.keep)
    write_report(tables, folder.directory, folder.fmt, folder)
