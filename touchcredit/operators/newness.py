"""Was the customer known before the campaign went out?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Known:
    """First appearance of every customer, and of every customer in every line."""

    customers: DataFrame  # customer_email, first_order, in_history
    lines: DataFrame  # email_lob, first_order, in_history


def first_appearances(seen: DataFrame) -> Known:
    """First order time per key, and whether the key is listed.

    ``seen`` has ``customer_email, email_lob, created_date, listed``. It is read and reduced to its pairs of
    keys once; both tables come from the pairs, of which a customer has as many as there are lines.
    """
    first = [F.min("created_date").alias("first_order"), F.max("listed").alias("in_history")]
    pairs = seen.groupBy("customer_email", "email_lob").agg(
        F.min("created_date").alias("created_date"), F.max("listed").alias("listed")
    )

    def per(key: str) -> DataFrame:
        # Behind a generator, what a join knows of its key is not pushed below the pairs: their shuffle stays one for both.
        rows = pairs.select(F.inline(F.array(F.struct(F.col(key).alias(key), "created_date", "listed"))))
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*first)

    return Known(per("customer_email"), per("email_lob"))


def known_customers(orders: DataFrame, history: DataFrame, before: Column | None = None) -> Known:
    """:func:`first_appearances` in the orders and in the historical list.

    One table serves any number of campaigns with different cut-off dates. ``orders`` is the whole cleaned
    table, not the campaign's scope. Pass the latest cut-off as ``before`` if it is known: later orders
    cannot make a customer known, and a literal bound reaches the scan.
    """
    earlier = orders.where(F.col("created_date") < before) if before is not None else orders
    seen = earlier.select("customer_email", "email_lob", "created_date", F.lit(False).alias("listed")).unionByName(
        history.select(
            "customer_email",
            "email_lob",
            F.lit(None).cast("timestamp_ntz").alias("created_date"),
            F.lit(True).alias("listed"),
        )
    )
    return first_appearances(seen)


def _flag(df: DataFrame, known: DataFrame, key: str, cutoff: Column, name: str) -> DataFrame:
    side = known.select(
        F.col(key).alias("__key"), F.col("first_order").alias("__first"), F.col("in_history").alias("__listed")
    )
    is_known = F.coalesce(F.col("__listed"), F.lit(False)) | F.coalesce(F.col("__first") < cutoff, F.lit(False))
    return (
        df.join(side, F.col(key) == F.col("__key"), "left")
        .withColumn(name, (~is_known).cast("int"))
        .drop("__key", "__first", "__listed")
    )


def flag_new(
    labelled: DataFrame, known: Known, campaign_table: DataFrame | None = None, cutoff: Column | None = None
) -> DataFrame:
    """Add ``new_to_company`` and ``new_to_lob``.

    A key is known if it is in the history or ordered before the cut-off, which is either one fixed time
    or the ``sent_date`` of the row's campaign. A null key is always new. ``new_to_lob`` is null for a
    customer who is new to the company.

    Works on orders and on cells of :func:`~touchcredit.operators.metrics.order_cells` alike. The join on
    the email comes last: rows leave it placed by email, which is what distinct customers are counted on.
    """
    df = labelled
    if cutoff is None:
        dates = campaign_table.select(
            F.col("campaign").alias("recent_open"), F.col("sent_date").alias("__cutoff")
        )
        df = df.join(dates, "recent_open")
        cutoff = F.col("__cutoff")
    df = _flag(df, known.lines, "email_lob", cutoff, "__new_line")
    df = _flag(df, known.customers, "customer_email", cutoff, "new_to_company")
    return df.withColumn("new_to_lob", F.when(F.col("new_to_company") == 0, F.col("__new_line"))).drop(
        "__new_line", "__cutoff"
    )
