"""Campaign index: one row per campaign email, one check-mark column per order type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_time
from .tables import read_table

NAME_COLUMNS = ("long_name", "short_name", "combined_name", "sent_date", "pos")


def read_index(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The wide index. ``pos`` is the row's place in the file unless the file states it.

    The place decides ties between touches, so an index kept as several files must bring its own ``pos``.
    """
    df = read_table(spark, path, fmt)
    if "pos" not in df.columns:
        if len(df.inputFiles()) > 1:
            raise ValueError("an index of several files needs a pos column")
        df = df.withColumn("pos", F.monotonically_increasing_id())
    df = df.withColumn("pos", F.col("pos").cast("long"))
    df = df.withColumn("long_name", F.replace(F.col("long_name"), F.lit("/"), F.lit("")))
    if df.schema["sent_date"].dataType.simpleString() == "string":
        return df.withColumn("sent_date", parse_time(F.col("sent_date")))
    return df.withColumn("sent_date", F.col("sent_date").cast("timestamp_ntz"))


def campaigns(index: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """``campaign, long_name, combined_name, sent_date, pos`` of every campaign.

    The roll-up name comes from the index if it has one, else from ``groups`` (campaign to roll-up);
    a campaign in no group has a null roll-up name.
    """
    if "combined_name" in index.columns:
        combined = F.col("combined_name")
    else:
        combined = F.lit(None).cast("string")
        for campaign, group in (groups or {}).items():
            combined = F.when(F.col("short_name") == campaign, group).otherwise(combined)
    return index.select(
        F.col("short_name").alias("campaign"),
        "long_name",
        combined.alias("combined_name"),
        "sent_date",
        "pos",
    )


def eligibility(index: DataFrame, order_types: list[str] | None = None) -> DataFrame:
    """``campaign, pos, order_type, eligible`` for every campaign and tracked order type.

    ``eligible`` is 1 where the index has any mark. Types without a single mark stay in the result, because
    an order of such a type is tracked and has opened none.
    """
    types = order_types or [name for name in index.columns if name not in NAME_COLUMNS]
    marks = [
        F.struct(F.lit(name).alias("order_type"), F.col(f"`{name}`").isNotNull().cast("int").alias("eligible"))
        for name in types
    ]
    return index.select(F.col("short_name").alias("campaign"), "pos", F.inline(F.array(*marks)))


def campaign_groups(campaign_table: DataFrame) -> DataFrame:
    """Roll-up names with the place at which each is first seen."""
    return (
        campaign_table.where("combined_name IS NOT NULL")
        .groupBy("combined_name")
        .agg(F.min("pos").alias("pos"))
    )
