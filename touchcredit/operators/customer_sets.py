"""Exact sets of customers that can be merged, as bitmaps.

Customers get dense numbers once. A campaign's customers are then bitmaps of 32,768 numbers each, and the customers of any
roll-up are the bitmaps of its campaigns put together: distinct counts at a level that nobody thought of before read no
order and no customer again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Customers are numbered in so many places at once, each in a task of its own.
PLACES = 256


def number_customers(customers: DataFrame, places: int = PLACES) -> DataFrame:
    """``customer_email, number``: every distinct customer with a number from 0, without gaps. Nulls get none.

    A place holds its share of the customers by hash, so no task numbers them all; the places' totals are a few rows.
    """
    place = F.pmod(F.xxhash64("customer_email"), F.lit(places)).alias("place")
    distinct = customers.where("customer_email IS NOT NULL").select("customer_email").distinct().select("customer_email", place)
    totals = distinct.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    # As one value of at most `places` entries: how many customers lie in the places before each.
    before = totals.agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("n")).select(
        F.map_from_entries(
            F.transform(
                F.map_keys("n"),
                lambda p: F.struct(p, F.aggregate(F.map_entries("n"), F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["key"] < p, e["value"]).otherwise(0))),
            )
        )
    )
    own = F.row_number().over(Window.partitionBy("place").orderBy("customer_email")) - 1
    return distinct.withColumn("own", own).select("customer_email", (F.element_at(before.scalar(), F.col("place")) + F.col("own")).alias("number"))


def customer_sets(rows: DataFrame, numbers: DataFrame, keys: Sequence[str], sets: Mapping[str, Column | None]) -> DataFrame:
    """``keys``, ``bucket`` and a bitmap for each of ``sets``: the customers with a row that meets its condition.

    Rows (orders or cells) are reduced to one for each customer and keys before they are moved; a bucket's rows meet in one
    task, and buckets are alike because numbers are dense.
    """
    met = [F.max(F.lit(True) if when is None else F.coalesce(when, F.lit(False))).alias(name) for name, when in sets.items()]
    once = rows.where("customer_email IS NOT NULL").groupBy(*keys, "customer_email").agg(*met)
    placed = once.join(numbers, "customer_email").withColumn("bucket", F.bitmap_bucket_number("number"))
    bit = F.bitmap_bit_position("number")
    made = [F.bitmap_construct_agg(F.when(F.col(name), bit)).alias(name) for name in sets]
    return placed.repartition("bucket").groupBy(*keys, "bucket").agg(*made)


def merge_sets(sets: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The union of the sets with equal ``keys``."""
    return sets.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(name).alias(name) for name in names])


def set_sizes(sets: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The number of customers of every set, per ``keys``."""
    return merge_sets(sets, keys, names).groupBy(*keys).agg(*[F.sum(F.bitmap_count(name)).alias(name) for name in names])
