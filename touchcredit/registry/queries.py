"""One query per operator or report, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import at, contains_word, not_in, register_functions
from ..operators import (
    acquired_measures,
    add_confirmed,
    by_click,
    by_list,
    by_window,
    by_windows,
    campaign_metrics,
    campaign_windows,
    clean_orders,
    customer_sets,
    direct_measures,
    enrich_orders,
    flag_new,
    in_scope,
    in_windows,
    known_customers,
    latest_touch,
    likely_members,
    number_customers,
    order_cells,
    quote_measures,
    set_sizes,
    status_measures,
    total_measures,
    touch_matrix,
    unique_measure,
)
from ..operators.attribution import weigh_copies
from ..operators.cleaning import clean_amounts, internal_rule, remap_lines, status_rule, territory_rule
from ..plans import (
    KnownState,
    ListCampaign,
    Publication,
    TouchCampaign,
    WindowCampaign,
    WindowCampaigns,
    cleaning_tables,
    list_campaign,
    published,
    touch_campaign,
    window_campaign,
    window_campaigns,
)
from ..plans.report import Keep, lazily
from ..sources import (
    campaigns,
    eligibility,
    read_index,
    read_open_list,
    read_touches,
    scan_orders,
    tidy_checked,
    work_folder,
)
from . import adapters as A
from .adapters import Given

SHIP_NAMES = ["camp_a", "camp_n", "camp_r"]
FLASH_NAMES = ["click", "view", "newsletter"]
SCOPE = (("1-URGENT", "3-MEDIUM"), ("L1", "L2", "L3"), "L0")


def money(df: DataFrame) -> DataFrame:
    """Exact amounts as doubles, the type that reports state."""
    exact = {f.name for f in df.schema if f.dataType.simpleString().startswith("decimal")}
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in exact else F.col(f"`{c}`") for c in df.columns])


# ---- cleaning -------------------------------------------------------------------------------------


def clean_status_rules(g: Given) -> DataFrame:
    kept = g.raw_sales.where(status_rule(A.RULES))
    return kept.select("order_id", "lob_type", "order_status", "quotation_number")


def clean_territory(g: Given) -> DataFrame:
    return g.raw_sales.where(territory_rule(A.RULES)).select("order_id", "territory")


def clean_amount_text(g: Given) -> DataFrame:
    clean, _ = clean_amounts(g.raw_sales, A.RULES)
    return money(clean.select("order_id", "billing_amount"))


def clean_internal_accounts(g: Given) -> DataFrame:
    rules = replace(A.RULES, internal_emails=("9.9$", "#0+1.7"))
    kept = g.raw_sales.where(internal_rule(rules))
    return remap_lines(kept, rules.remapped_lines).select("order_id", "institution", "lob_type")


def clean_all_rules(g: Given) -> DataFrame:
    clean, _ = clean_orders(g.raw_sales, A.RULES)
    return money(clean)


# ---- derived columns ------------------------------------------------------------------------------


def enrich_lob_key(g: Given) -> DataFrame:
    return enrich_orders(g.raw_sales, A.CODES).select("order_id", "customer_email", "lob", "email_lob")


def order_flags(g: Given) -> DataFrame:
    orders = g.sales
    three_way = add_confirmed(orders, A.QUOTE_LINES)
    two_way = add_confirmed(three_way.withColumnRenamed("confirmed", "confirmed_by_quote"), None)
    return two_way.select("order_id", "quote_based", "confirmed_by_quote", "confirmed")


def scope_filter(g: Given) -> DataFrame:
    return g.sales.where(in_scope(*SCOPE)).select("order_id", "lob", "priority")


def eligibility_unpivot(g: Given) -> DataFrame:
    """Orders and revenue each campaign could be credited with by order type alone."""
    pairs = g.ship_eligibility.where("eligible = 1")
    joined = g.sales.join(pairs, "order_type")
    return money(
        joined.groupBy("campaign", "order_type").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("billing_amount").alias("revenue")
        )
    )


# ---- attribution ----------------------------------------------------------------------------------


def _flash_orders(sales: DataFrame) -> DataFrame:
    orders = sales.where(F.col("created_date") >= at(A.FLASH_START))
    return add_confirmed(orders.where(contains_word(F.col("promotion_code"), "flash")), A.QUOTE_LINES)


def _flash_labelled(g: Given, sales: DataFrame) -> DataFrame:
    return by_list(_flash_orders(sales), g.touches_lists)


def list_attribution(g: Given) -> DataFrame:
    return money(_flash_labelled(g, g.sales).select("order_id", "recent_open", "confirmed", "billing_amount"))


def list_attribution_prefiltered(g: Given) -> DataFrame:
    """As list_attribution, with a filter of the recipients before the shuffle of the orders."""
    labelled = by_list(likely_members(_flash_orders(g.sales), g.touches_lists), g.touches_lists)
    return money(labelled.select("order_id", "recent_open", "confirmed", "billing_amount"))


def list_attribution_fanout(g: Given) -> DataFrame:
    """Duplicate list entries kept as weights: orders and revenue as if every copy were a row."""
    cells = order_cells(_flash_orders(g.sales), ["customer_email"])
    cells = weigh_copies(by_list(cells, g.touches_lists, keep_fanout=True))
    return money(campaign_metrics(cells, total_measures() + unique_measure(), orders_col="orders"))


def click_attribution(g: Given) -> DataFrame:
    labelled = by_click(_flash_orders(g.sales), g.touches_lists)
    return money(labelled.select("order_id", "recent_open", "billing_amount"))


def touch_matrix_query(g: Given) -> DataFrame:
    return touch_matrix(g.plain_orders, g.touches_ship, SHIP_NAMES).select(
        "order_id", *SHIP_NAMES
    )


def _window_list(g: Given) -> DataFrame:
    return g.touches_ship.where("campaign = 'camp_r'")


def _window_labelled(g: Given, scope: Column) -> DataFrame:
    return by_window(g.sales, _window_list(g), at("7/1/1997"), scope=scope)


def window_attribution_lob(g: Given) -> DataFrame:
    labelled = _window_labelled(g, F.col("lob_type").isin("L2", "L3"))
    return labelled.select("order_id", "recent_open", "created_date", "lob")


def window_attribution_priority(g: Given) -> DataFrame:
    labelled = _window_labelled(g, F.col("priority").isin("1-URGENT"))
    return labelled.select("order_id", "recent_open", "created_date", "priority")


def windows_of_index(g: Given) -> DataFrame:
    """Orders of every list of the index in the 31 days after its own send date, in its own scope."""
    windows = campaign_windows(g.ship_campaigns, scopes=g.ship_scopes)
    labelled = by_windows(g.sales, g.touches_ship, windows, "lob_type")
    return labelled.select("order_id", "recent_open", "created_date", "lob")


def windows_of_weeks(g: Given) -> DataFrame:
    """Purchases in the windows of fifteen campaigns of three days each, whoever made them; windows overlap."""
    labelled = in_windows(g.event_orders, campaign_windows(g.event_campaigns, days=3), days=3)
    return labelled.groupBy("recent_open").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("billing_amount").cast("decimal(18,4)")).cast("double").alias("revenue"))


def latest_touch_query(g: Given) -> DataFrame:
    labelled = latest_touch(g.plain_orders, g.touches_ship, g.ship_eligibility)
    return labelled.select("order_id", "recent_open")


def latest_touch_events(g: Given) -> DataFrame:
    labelled = latest_touch(g.event_orders, g.touches_events, g.event_eligibility)
    return labelled.select("order_id", "recent_open")


def latest_touch_complete(g: Given) -> DataFrame:
    """Every order with a touch of any campaign, with all three outcomes."""
    labelled = latest_touch(
        g.current, g.touches_ship, g.ship_eligibility, complete=True
    )
    return labelled.select("order_id", "order_type", "recent_open")


# ---- reports --------------------------------------------------------------------------------------


def flash_report(g: Given) -> dict[str, DataFrame]:
    names = A.spine(g.spark, FLASH_NAMES).withColumnRenamed("recent_open", "campaign")
    spec = ListCampaign(A.FLASH_START, "flash", "Flash", lines=A.REPORT_LINES)
    return list_campaign(g.sales, g.known(A.FLASH_START), g.touches_lists, names, spec)


def research_report(g: Given, keep_fanout: bool = False, keep: Keep = lazily) -> dict[str, DataFrame]:
    spec = TouchCampaign.research_areas(keep_fanout=keep_fanout, lines=A.REPORT_LINES)
    latest = g.known("1997-01-01 00:00:00")
    return touch_campaign(g.current, latest, g.touches_ship, g.ship_campaigns, g.ship_eligibility, spec, keep)


def promo_report(g: Given) -> dict[str, DataFrame]:
    """The promotions' index has no roll-up names; they are given beside it."""
    codes = ("NGS-3", "NGS-4", "FLASH-1")
    spec = TouchCampaign.promotion(in_scope(*SCOPE), codes, lines=A.REPORT_LINES)
    table = campaigns(g.ship_index.drop("combined_name"), {"camp_a": "early", "camp_n": "early", "camp_r": "late"})
    latest = g.known("1997-01-01 00:00:00")
    return touch_campaign(g.current, latest, g.touches_ship, table, g.ship_eligibility, spec)


def regional_report(g: Given) -> dict[str, DataFrame]:
    start = "7/1/1997"
    spec = WindowCampaign(start, F.col("lob_type").isin("L2", "L3"), "Region")
    return window_campaign(g.sales, g.known(start), _window_list(g), spec)


def regions_report(g: Given) -> dict[str, DataFrame]:
    """The regional report for all campaigns of the index."""
    latest = g.known("1997-01-01 00:00:00")
    return window_campaigns(g.sales, latest, g.touches_ship, g.ship_campaigns, g.ship_scopes, WindowCampaigns())


def _table(report: Callable[[Given], dict[str, DataFrame]], title: str, *columns: str) -> Callable[[Given], DataFrame]:
    """A query that returns one table of a report."""

    def query(g: Given) -> DataFrame:
        df = report(g)[title]
        return money(df.select(*columns) if columns else df)

    query.__name__ = f"{report.__name__}_{title}"
    return query


def _metrics_of(measures: Callable[[], list]) -> Callable[[Given], DataFrame]:
    """Some of the measures that need no newness, over the credited orders as rows."""

    def query(g: Given) -> DataFrame:
        labelled = add_confirmed(latest_touch(g.current, g.touches_ship, g.ship_eligibility), A.QUOTE_LINES)
        return money(campaign_metrics(labelled, measures(), spine=A.spine(g.spark, SHIP_NAMES)))

    return query


def _columns_of(measures: Callable[[], list]) -> Callable[[Given], DataFrame]:
    """Some of the columns of the research report's metrics."""

    def query(g: Given) -> DataFrame:
        return money(research_report(g)["Metrics"].select("recent_open", *[m.name for m in measures()]))

    return query


FLAGS = ("order_id", "recent_open", "new_to_company", "new_to_lob")


def research_fanout(g: Given) -> DataFrame:
    """Metrics in which an order counts as often as its touch was listed."""
    return money(research_report(g, keep_fanout=True)["Metrics"])


def known_by_history(g: Given) -> DataFrame:
    """Newness against the historical list and the orders, each read as a table of its own."""
    start = at(A.FLASH_START)
    known = known_customers(g.current, g.history, before=start)
    flagged = flag_new(_flash_labelled(g, g.sales), known, cutoff=start)
    return flagged.groupBy("recent_open", "new_to_company", "new_to_lob").agg(F.count(F.lit(1)).alias("orders"))


def known_by_batches(g: Given) -> DataFrame:
    """Newness against a state that took in the historical list and the orders of each year, one of them twice."""
    state = KnownState(g.spark, work_folder(g.spark, "known"))
    state.merge("history", history=g.history)
    for year in ("1996", "1997", "1996"):
        state.merge(year, g.current.where(F.year("created_date") == int(year)))
    state.merge("later", g.current.where(F.year("created_date") > 1997))
    flagged = flag_new(_flash_labelled(g, g.sales), state.known(), cutoff=at(A.FLASH_START))
    return flagged.groupBy("recent_open", "new_to_company", "new_to_lob").agg(F.count(F.lit(1)).alias("orders"))


def customers_by_sets(g: Given) -> DataFrame:
    """Distinct customers of campaigns, roll-ups and all, and of each with urgent orders, from sets of customers.

    The sets are written; every level is counted from them.
    """
    orders = latest_touch(g.current, g.touches_ship, g.ship_eligibility)
    names = {"customers": None, "urgent": F.col("priority") == "1-URGENT"}
    path = work_folder(g.spark, "sets")
    numbers = number_customers(g.current)
    customer_sets(orders, numbers, ["recent_open"], names).write.parquet(path)
    sets = g.spark.read.parquet(path)
    groups = g.ship_campaigns.select(F.col("campaign").alias("recent_open"), "combined_name")
    levels = {"campaign": sets.withColumn("key", F.col("recent_open")), "total": sets.withColumn("key", F.lit(None).cast("string"))}
    levels["combined"] = sets.join(groups, "recent_open").withColumnRenamed("combined_name", "key")
    out = [set_sizes(rows, ["key"], list(names)).select(F.lit(level).alias("level"), "*") for level, rows in levels.items()]
    return out[0].union(out[1]).union(out[2])


#: As a user would write it.
USER_SQL = """
SELECT l.campaign AS recent_open, s.lob_type, count(*) AS orders, CAST(sum(s.billing_amount) AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN s.confirmed = 'confirmed' THEN s.billing_amount ELSE 0 END) AS DOUBLE) AS confirmed_revenue,
  count(DISTINCT s.customer_email) AS customers,
  count(DISTINCT CASE WHEN is_new(k.first_order, FALSE, CAST(:start AS TIMESTAMP_NTZ)) = 1 THEN s.customer_email END) AS new_customers
FROM clean_orders() s
JOIN (SELECT DISTINCT campaign, recipient FROM given_lists) l ON l.recipient = s.customer_email
LEFT JOIN known_customers(CAST(:start AS TIMESTAMP_NTZ)) k ON k.customer_email = s.customer_email
WHERE s.created_date >= CAST(:start AS TIMESTAMP_NTZ) AND contains(lower(s.promotion_code), :word)
GROUP BY l.campaign, s.lob_type
"""


def metrics_in_sql(g: Given) -> DataFrame:
    """Metrics of the list campaign in SQL, with the rules as SQL functions and the campaign's values as arguments."""
    g.raw_sales.createOrReplaceTempView("given_orders")
    g.touches_lists.createOrReplaceTempView("given_lists")
    register_functions(g.spark, A.RULES, A.CODES, A.QUOTE_LINES, "given_orders")
    return g.spark.sql(USER_SQL, args={"start": A.FLASH_START, "word": "flash"})


def clean_rejects(g: Given) -> DataFrame:
    """Orders whose amount cannot be read: amounts of one key in eleven are spoiled first."""
    spoiled = F.when(F.col("order_id") % 11 == 0, F.concat("billing_amount", F.lit(" net"))).otherwise(F.col("billing_amount"))
    unset = F.when(F.col("order_id") % 13 != 0, spoiled)
    tables = cleaning_tables(g.raw_sales.withColumn("billing_amount", unset), A.RULES)
    return tables["Rejects"].select("order_id", "billing_amount")


def cleaning_audit(g: Given) -> DataFrame:
    """What became of every order of a spoiled export, by the first rule that took it away."""
    return money(cleaning_tables(tidy_checked(g.export), A.RULES)["Audit"])


def rejects_by_reason(g: Given) -> DataFrame:
    rejects = cleaning_tables(tidy_checked(g.export), A.RULES)["Rejects"]
    return rejects.select(F.col("order_id").cast("bigint").alias("order_id"), "reason", "billing_amount", "bad_time")


def export_read_back(g: Given) -> DataFrame:
    """The export written as a file whose every 23rd row has lost its last field and every 29th has one too many, read with
    declared columns: every row is kept, dropped by a rule, or a reject with its reason."""
    path, columns = work_folder(g.spark, "export"), g.export.columns
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"')) for c in columns]
    key = F.col("order_id").cast("bigint")
    short, whole = F.concat_ws(",", *quoted[:-1]), F.concat_ws(",", *quoted)
    line = F.when(key % 23 == 0, short).when(key % 29 == 0, F.concat(whole, F.lit(',"x"'))).otherwise(whole)
    g.export.select(line.alias("value")).write.text(path)
    rows = scan_orders(g.spark, path, columns, header=False)
    return money(cleaning_tables(rows, A.RULES)["Audit"])


def lists_read_back(g: Given) -> DataFrame:
    """Credits by an index and open lists that were written as files: one list for each campaign, read by its long name."""
    path = work_folder(g.spark, "lists")
    # A list's campaign is a condition on the touches, which reaches the scan: each list is made of its own lines alone.
    for short_name, long_name in (("camp_a", "Camp A"), ("camp_n", "Camp N"), ("camp_r", "Camp R")):
        sent = g.touches_ship.where(F.col("campaign") == short_name).select(
            F.upper("recipient").alias("Recipient"),
            F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("Sent At (your time zone)"),
        )
        sent.write.option("header", True).csv(f"{path}/lists/{long_name}")
    slashed = g.ship_index.withColumns(
        {"long_name": F.replace(F.col("long_name"), F.lit(" "), F.lit("/ ")), "sent_date": F.date_format("sent_date", "M/d/yyyy")}
    )
    slashed.coalesce(1).write.option("header", True).csv(f"{path}/index")
    index = read_index(g.spark, f"{path}/index")
    touches = read_touches(g.spark, f"{path}/lists", campaigns(index))
    return latest_touch(g.plain_orders, touches, eligibility(index)).select("order_id", "recent_open")


def one_list_read_back(g: Given) -> DataFrame:
    """Members of one list that was written as a file and read under a given name."""
    path = work_folder(g.spark, "list")
    rows = g.touches_lists.where("campaign = 'click'").select(
        F.upper("recipient").alias("Recipient"), F.date_format("sent_at", "M/d/yyyy").alias("Sent At (your time zone)"),
        F.col("clicked").alias("Clicked"),
    )
    rows.write.option("header", True).csv(path)
    return read_open_list(g.spark, path, "mine").groupBy("campaign", "recipient", "sent_at").agg(
        F.count(F.lit(1)).alias("listings"), F.count_if("clicked").alias("clicks")
    )


def _published_research(g: Given) -> dict[str, DataFrame]:
    """The research report published as a whole and read back."""
    run = Publication(g.spark, work_folder(g.spark, "report"))
    run.publish(research_report(g, keep=run.keep))
    return published(g.spark, run.directory)


def published_complete(g: Given) -> DataFrame:
    return _published_research(g)["Labelled Complete"].select("order_id", "order_type", "recent_open")


def published_levels(g: Given) -> DataFrame:
    return money(_published_research(g)["Metrics by Level"])


def clean_report(g: Given) -> DataFrame:
    """Orders and revenue by line in the cleaned and the ready table."""
    tables = cleaning_tables(g.raw_sales, A.RULES)
    parts = [
        tables[name].groupBy("lob_type").agg(F.count(F.lit(1)).alias("orders"), F.sum("billing_amount").alias("revenue"))
        .select(F.lit(name).alias("stage"), "*")
        for name in ("Cleaned", "Ready")
    ]
    return money(parts[0].union(parts[1]))


def null_safe_exclusion(g: Given) -> DataFrame:
    """Null-safe exclusion over a column with nulls: orders without one of the excluded codes."""
    kept = g.raw_sales.where(not_in(F.col("promotion_code"), ["FLASH-0", "NGS-5"]))
    return kept.groupBy("promotion_code").agg(F.count(F.lit(1)).alias("orders"))


_ON_GIVEN: dict[str, Callable[[Given], DataFrame]] = {
    "clean_status_rules": clean_status_rules,
    "clean_territory": clean_territory,
    "clean_amounts": clean_amount_text,
    "clean_internal_accounts": clean_internal_accounts,
    "clean_all_rules": clean_all_rules,
    "null_safe_exclusion": null_safe_exclusion,
    "enrich_lob_key": enrich_lob_key,
    "order_flags": order_flags,
    "scope_filter": scope_filter,
    "eligibility_unpivot": eligibility_unpivot,
    "list_attribution": list_attribution,
    "list_attribution_prefiltered": list_attribution_prefiltered,
    "list_attribution_fanout": list_attribution_fanout,
    "click_attribution": click_attribution,
    "touch_matrix": touch_matrix_query,
    "window_attribution_lob": window_attribution_lob,
    "window_attribution_priority": window_attribution_priority,
    "windows_of_index": windows_of_index,
    "windows_of_weeks": windows_of_weeks,
    "latest_touch": latest_touch_query,
    "latest_touch_events": latest_touch_events,
    "latest_touch_complete": latest_touch_complete,
    "new_to_company": _table(flash_report, "Open Email", *FLAGS),
    "new_to_lob": _table(research_report, "Labelled", *FLAGS),
    "known_by_history": known_by_history,
    "known_by_batches": known_by_batches,
    "customers_by_sets": customers_by_sets,
    "metrics_in_sql": metrics_in_sql,
    "clean_rejects": clean_rejects,
    "clean_report": clean_report,
    "cleaning_audit": cleaning_audit,
    "rejects_by_reason": rejects_by_reason,
    "export_read_back": export_read_back,
    "lists_read_back": lists_read_back,
    "one_list_read_back": one_list_read_back,
    "published_complete": published_complete,
    "published_levels": published_levels,
    "flash_metrics": _table(flash_report, "Metrics"),
    "flash_all_orders": _table(flash_report, "All Sources", "order_id", "promotion_code", "confirmed", "billing_amount"),
    "flash_clicked": _table(flash_report, "Open and Click", "order_id", "recent_open", "billing_amount"),
    "flash_customers": _table(flash_report, "New Customers"),
    "research_metrics": _table(research_report, "Metrics"),
    "research_fanout": research_fanout,
    "combined_metrics": _table(research_report, "Metrics Combined"),
    "metrics_by_level": _table(research_report, "Metrics by Level"),
    "promo_by_level": _table(promo_report, "Metrics by Level"),
    "quote_metrics": _metrics_of(lambda: quote_measures(A.QUOTE_LABELS)),
    "direct_metrics": _metrics_of(lambda: direct_measures(A.DIRECT_LABELS)),
    "status_metrics": _columns_of(lambda: status_measures(A.COMPANY, A.NEW_LINE_LABELS)),
    "new_customers_by_lob": _columns_of(lambda: acquired_measures(A.COMPANY, A.NEW_LINE_LABELS)),
    "unique_customers": _metrics_of(unique_measure),
    "promo_metrics": _table(promo_report, "Metrics"),
    "promo_combined": _table(promo_report, "Metrics Combined"),
    "promo_lob_detail": _table(promo_report, "Detail"),
    "promo_revenue_split": _table(promo_report, "Revenue Breakdown"),
    "revenue_by_code": _table(promo_report, "Breakdown By Code"),
    "regional_metrics": _table(regional_report, "Metrics"),
    "regional_metric_rows": _table(regional_report, "Metric Rows"),
    "regional_orders": _table(regional_report, "Labelled", *FLAGS),
    "regions_metrics": _table(regions_report, "Metrics"),
    "regions_orders": _table(regions_report, "Labelled", *FLAGS),
    "regions_customers": _table(regions_report, "New Customers"),
    "revenue_breakdown": _table(flash_report, "Breakdown"),
    "new_customer_list": _table(research_report, "New Customers"),
}


def _on_folder(query: Callable[[Given], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Given(spark, sf_dir))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {name: _on_folder(query) for name, query in _ON_GIVEN.items()}
