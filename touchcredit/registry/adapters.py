"""The given tables seen as orders, open lists and a campaign index.

The tables hold no currency text, quotation number or email, so these columns are derived from keys in a
way that SQL engines agree on. They are given the headers of an export and go through the readers' own
renaming. Every adapter reads its tables whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import at
from ..operators import CleaningRules, Known, clean_orders, enrich_orders, first_appearances
from ..plans import Lines
from ..sources import campaigns, eligibility, read_table, tidy_history, tidy_orders, tidy_touches

CODES = {"L0": "c0", "L1": "c1", "L2": "c2", "L3": "c3", "L4": "c4", "L5": "c5"}  # L6 keeps its name
QUOTE_LINES = ("L0", "L1", "L2", "L3")
QUOTE_LABELS = {"L0": "L0", "L1": "L1", "L2": "L2", "L3": "L3"}
DIRECT_LABELS = {"L4": "L4", "L5": "L5", "L6": "L6"}
NEW_LINE_LABELS = {"C0": "c0", "C1": "c1", "C2": "c2", "C3": "c3", "C4": "c4", "C5": "c5", "C6": "L6"}
COMPANY = "Company"
REPORT_LINES = Lines(QUOTE_LABELS, DIRECT_LABELS, NEW_LINE_LABELS, QUOTE_LABELS, {"L1": "L1", "L3": "L3"}, QUOTE_LINES)
RULES = CleaningRules(
    quote_lines=(*QUOTE_LINES, "L7"),
    territories=("NATION_20", "NATION_21"),
    internal_institutions=("NATION_24",),
    remapped_lines={"L7": "L0"},
)
HISTORY_END = "1996-01-01 00:00:00"
FLASH_START = "1997-01-01 00:00:00"
ORDER_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


LINES = ["L0", "L1", "L2", "L3", "L4", "L5", "L6", "L7"]
PROMOTION_CODES = ["FLASH-0", "FLASH-1", "FLASH-2", "NGS-3", "NGS-4", "NGS-5"]
SIGNS = ["JPY.￥", "£", "€", "AU$"]
STATUSES = [
    "Ready To Order", "Complete", "Complete",
    "Cart", "In Process", "In Process",
    "Draft", "Pending Quote", "Discard",
]


def _pick(values: list[str], place: Column) -> Column:
    """The value at a place of a constant array, null beyond it; shorter code than a chain of CASE."""
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def _recipient(key: Column) -> Column:
    digits = key.cast("string")
    return F.concat(F.lit("customer#"), F.lpad(digits, F.greatest(F.length(digits), F.lit(9)), F.lit("0")))


class Given:
    """The tables of one folder; every derived table is built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @cached_property
    def events(self) -> DataFrame:
        return self._table("events")

    @cached_property
    def raw_sales(self) -> DataFrame:
        """One row per order, as the raw export would hold it."""
        customer, nation = self._table("customer"), self._table("nation")
        key = F.col("o_orderkey")
        status = _pick(STATUSES, (F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1) * 3 + key % 3)
        sign = F.coalesce(_pick(SIGNS, F.col("o_custkey") % 20), F.lit("$"))
        number = F.when(key % 50 == 7, "0.0000").otherwise(
            F.col("o_totalprice").cast("decimal(18,4)").cast("string")
        )
        export = (
            self.orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("order_id"),
                F.col("o_orderdate").alias("CreatedDate"),
                F.col("c_name").alias("CustomerEmail"),
                F.col("c_name").alias("UserName"),
                F.col("n_name").alias("Institution"),
                F.col("n_name").alias("Territory"),
                _pick(LINES, key % 8).alias("LineOfBusinessType"),
                F.col("o_orderpriority").alias("OrderType"),
                F.col("o_orderpriority").alias("Priority"),
                status.alias("OrderStatus"),
                F.when(key % 5 < 2, key.cast("string")).alias("QuotationNumber"),
                _pick(PROMOTION_CODES, key % 10).alias("PromotionCode"),
                F.concat(sign, number).alias("BillingAmount"),
            )
        )
        return tidy_orders(export)

    @cached_property
    def export(self) -> DataFrame:
        """The raw export as text, with its own headers. Times of one key in 17 are words, of one in 19 have the day first;
        one amount in eleven has words, one in thirteen is missing."""
        key, day = F.col("order_id"), F.date_format("created_date", "yyyy-MM-dd HH:mm:ss")
        time = F.when(key % 17 == 0, "next week").when(key % 19 == 0, "30/07/2019").otherwise(day)
        amount = F.when(key % 11 == 0, F.concat("billing_amount", F.lit(" net"))).otherwise(F.col("billing_amount"))
        spoiled = self.raw_sales.withColumns({"created_date": time, "billing_amount": F.when(key % 13 != 0, amount)})
        named = spoiled.withColumnsRenamed({own: header for header, own in C.ORDER_COLUMNS.items()})
        return named.select(*[F.col(c).cast("string").alias(c) for c in named.columns])

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean_orders(self.raw_sales, RULES)[0]

    @cached_property
    def sales(self) -> DataFrame:
        """All cleaned and enriched orders, old and current."""
        return enrich_orders(self.cleaned, CODES)

    @cached_property
    def history(self) -> DataFrame:
        """The historical customer list: cleaned orders before the current table begins."""
        old = self.sales.where(F.col("created_date") < at(HISTORY_END))
        return tidy_history(old.select(F.col("customer_email").alias("Email"), F.col("email_lob").alias("Email + LoB")))

    @cached_property
    def current(self) -> DataFrame:
        """The current order table."""
        return self.sales.where(F.col("created_date") >= at(HISTORY_END))

    def known(self, before: str) -> Known:
        """Keys of the historical list and of current orders before a time: both are one table here, read once."""
        listed = F.col("created_date") < at(HISTORY_END)
        seen = self.sales.where(F.col("created_date") < at(before))
        return first_appearances(seen.select("customer_email", "email_lob", "created_date", listed.alias("listed")))

    @cached_property
    def touches_lists(self) -> DataFrame:
        """Two open lists from events: every view and every click is a listing, those of high value were clicked."""
        lists = self.events.where("event_type IN ('view', 'click')").select(
            "event_type",
            _recipient(F.col("user_id")).alias("Recipient"),
            F.col("ts").alias("Sent At (your time zone)"),
            (F.col("value") > 250).alias("Clicked"),
        )
        return tidy_touches(lists, F.col("event_type"))

    @cached_property
    def touches_ship(self) -> DataFrame:
        """Three campaigns from shipments, at day grain, so that ties occur.

        Lines are looked up in their orders by hash: a task holds its share of the orders, a fourth of the lines, and sorts none.
        """
        lines = self._table("lineitem")
        return lines.join(self.orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("camp_"), F.lower("l_returnflag")).alias("campaign"),
            _recipient(F.col("o_custkey")).alias("recipient"),
            F.col("l_shipdate").alias("sent_at"),
            F.lit(None).cast("boolean").alias("clicked"),
        )

    @cached_property
    def plain_orders(self) -> DataFrame:
        """The order table without cleaning: key, customer, time, type."""
        return self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            _recipient(F.col("o_custkey")).alias("customer_email"),
            F.col("o_orderdate").alias("created_date"),
            F.col("o_orderpriority").alias("order_type"),
        )

    @cached_property
    def touches_events(self) -> DataFrame:
        """Fifteen campaigns from events: three types by week of month, at microsecond grain."""
        week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
        return self.events.where("event_type IN ('view', 'click', 'signup')").select(
            F.concat("event_type", F.lit("-w"), week).alias("campaign"),
            F.col("user_id").cast("string").alias("recipient"),
            F.col("ts").alias("sent_at"),
            F.lit(None).cast("boolean").alias("clicked"),
        )

    @cached_property
    def event_orders(self) -> DataFrame:
        """Purchases as orders."""
        return self.events.where("event_type = 'purchase'").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").cast("string").alias("customer_email"),
            F.col("ts").alias("created_date"),
            F.col("event_type").alias("order_type"),
            F.col("value").alias("billing_amount"),
        )

    @cached_property
    def ship_index(self) -> DataFrame:
        """The wide index of the shipment campaigns, with marks per order type."""
        return self.spark.sql(
            """
            SELECT * FROM VALUES
              ('Camp A', 'camp_a', 'ship_an', TIMESTAMP_NTZ'1996-01-01 00:00:00', 0L, 'x', NULL, 'x'),
              ('Camp N', 'camp_n', 'ship_an', TIMESTAMP_NTZ'1996-07-01 00:00:00', 1L, 'x', 'x', NULL),
              ('Camp R', 'camp_r', 'ship_r', TIMESTAMP_NTZ'1997-01-01 00:00:00', 2L, NULL, 'x', 'x')
            AS t(long_name, short_name, combined_name, sent_date, pos, `1-URGENT`, `2-HIGH`, `3-MEDIUM`)
            """
        )

    @cached_property
    def ship_campaigns(self) -> DataFrame:
        return campaigns(self.ship_index)

    @cached_property
    def ship_eligibility(self) -> DataFrame:
        return eligibility(self.ship_index, ORDER_TYPES)

    @cached_property
    def ship_scopes(self) -> DataFrame:
        """Lines that two of the shipment campaigns are limited to; the third takes all."""
        return self.spark.sql(
            "SELECT * FROM VALUES ('camp_n', 'L2'), ('camp_n', 'L3'), ('camp_r', 'L0'), ('camp_r', 'L4') AS t(campaign, value)"
        )

    @cached_property
    def event_campaigns(self) -> DataFrame:
        """The event campaigns with a send date two days after each other."""
        return self.spark.sql(
            """
            SELECT concat(kind, '-w', week) AS campaign,
              TIMESTAMP_NTZ'2024-01-01 06:00:00' + make_dt_interval(2 * (5 * k + week)) AS sent_date
            FROM VALUES ('view', 0), ('click', 1), ('signup', 2) AS t(kind, k)
            LATERAL VIEW explode(sequence(0, 4)) w AS week
            """
        )

    @cached_property
    def event_eligibility(self) -> DataFrame:
        """Every event campaign is eligible for purchases."""
        return self.spark.sql(
            """
            SELECT concat(kind, '-w', week) AS campaign, 5L * k + week AS pos, order_type, 1 AS eligible
            FROM VALUES ('view', 0, 'purchase'), ('click', 1, 'purchase'), ('signup', 2, 'purchase')
              AS t(kind, k, order_type)
            LATERAL VIEW explode(sequence(0, 4)) w AS week
            """
        )


def spine(spark: SparkSession, names: list[str]) -> DataFrame:
    """Campaign names in report order."""
    rows = ", ".join(f"('{name}', {i})" for i, name in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(recent_open, pos)")
