"""Order export and historical customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import parse_time, unreadable
from .headers import normalise_headers


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Read one table, of one or several files. CSV is read as text, without an inference pass over the data."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"')
    return reader.load(path)


def _as_time(df: DataFrame, name: str) -> DataFrame:
    kind = df.schema[name].dataType.simpleString()
    if kind == "timestamp_ntz":
        return df
    if kind == "string":
        return df.withColumn(name, parse_time(F.col(name)))
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def tidy_orders(df: DataFrame) -> DataFrame:
    """Rename the known columns, type the creation time; other columns pass through."""
    return _as_time(df.withColumnsRenamed(C.ORDER_COLUMNS), "created_date")


def read_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Order table, raw or cleaned; a sheet of a workbook is a sub-path here."""
    return tidy_orders(read_table(spark, path, fmt))


#: What a checked scan adds: the text of a row that has not the declared columns, and of a time that cannot be read.
BAD_ROW, BAD_TIME = "bad_row", "bad_time"


def tidy_checked(df: DataFrame) -> DataFrame:
    """As :func:`tidy_orders`, with the text of a time that cannot be read kept as ``bad_time``."""
    named = df.withColumnsRenamed(C.ORDER_COLUMNS)
    text = F.col("created_date").cast("string")
    return _as_time(named.withColumn(BAD_TIME, F.when(unreadable(text), text)), "created_date")


def scan_orders(spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True) -> DataFrame:
    """An order export as CSV with declared ``columns``; no row of a spoiled file is lost.

    A row with more or fewer fields than declared is kept whole as ``bad_row``, a time that cannot be read as
    ``bad_time``; :func:`~touchcredit.operators.cleaning.clean_stages` sends both to the rejects. A file whose header
    is not the declared one is an error; with ``header=False`` files have none. All fields are parsed even where few are asked for, because a row's shape
    cannot be judged otherwise.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, BAD_ROW)])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW)
    reader = reader.option("header", header).option("enforceSchema", not header).option("escape", '"').option("columnPruning", False)
    return tidy_checked(reader.csv(path))


def tidy_history(df: DataFrame) -> DataFrame:
    named = normalise_headers(df).withColumnsRenamed(C.HISTORY_COLUMNS)
    return named.select(
        F.lower("customer_email").alias("customer_email"), F.lower("email_lob").alias("email_lob")
    )


def read_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Customers known before the order table begins: ``customer_email, email_lob``."""
    return tidy_history(read_table(spark, path, fmt))
