"""Reports that readers see as a whole.

A run writes its tables below a folder of its own. When all of them are there and have been counted, one row is added to
the folder's manifest: that row is the switch. Readers follow the newest row, so until it is there they see the report
before it, and a run that dies half-way leaves nothing but a folder that no manifest names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq bigint, version string, tables array<struct<title: string, path: string, fmt: string, rows: bigint>>"
READ_BACK = ("parquet", "orc")


def _manifests(spark: SparkSession, directory: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{directory.rstrip('/')}/manifests")
    except AnalysisException:  # nothing was published yet
        return None


def newest(spark: SparkSession, directory: str):
    """The manifest row of the newest published report, or None."""
    rows = _manifests(spark, directory)
    return None if rows is None else rows.orderBy(F.desc("seq"), F.desc("version")).first()


def published(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables of the newest published report."""
    row = newest(spark, directory)
    if row is None:
        raise FileNotFoundError(f"no report was published in {directory}")
    out = {}
    for t in row.tables:
        reader = spark.read.format(t.fmt)
        out[t.title] = (reader.option("header", True) if t.fmt == "csv" else reader).load(f"{directory.rstrip('/')}/{t.path}")
    return out


@dataclass
class Publication:
    """One run's tables, below ``directory``; :meth:`keep` is what reports take, :meth:`publish` makes them seen."""

    spark: SparkSession
    directory: str
    fmt: str = "parquet"
    version: str = field(default_factory=lambda: uuid.uuid4().hex)
    paths: dict[str, str] = field(default_factory=dict)

    def _full(self, path: str) -> str:
        return f"{self.directory.rstrip('/')}/{path}"

    def write(self, title: str, df: DataFrame) -> None:
        path = f"versions/{self.version}/{re.sub(r'[^a-z0-9]+', '_', title.lower()).strip('_')}"
        writer = df.write.mode("overwrite").format(self.fmt)
        (writer.option("header", True) if self.fmt == "csv" else writer).save(self._full(path))
        self.paths[title] = path

    def keep(self, title: str, df: DataFrame) -> DataFrame:
        """The table as written; text formats lose types, so there it is only written and not read back."""
        self.write(title, df)
        if self.fmt not in READ_BACK:
            return df
        return self.spark.read.schema(df.schema).format(self.fmt).load(self._full(self.paths[title]))

    def publish(self, tables: Mapping[str, DataFrame]) -> str:
        """Write what is not written yet, count everything, and switch readers over. Returns the version."""
        for title, df in tables.items():
            if title not in self.paths:
                self.write(title, df)
        entries = []
        for title in tables:
            reader = self.spark.read.format(self.fmt)
            reader = reader.option("header", True) if self.fmt == "csv" else reader.schema(tables[title].schema)
            entries.append((title, self.paths[title], self.fmt, reader.load(self._full(self.paths[title])).count()))
        last = newest(self.spark, self.directory)
        row = self.spark.createDataFrame([((last.seq if last else 0) + 1, self.version, entries)], MANIFEST)
        # One row is one file, and a file appears by one rename (or one put).
        row.coalesce(1).write.mode("append").json(self._full("manifests"))
        return self.version


def overwrite_months(df: DataFrame, path: str, ts: str = "created_date") -> None:
    """Write an order table by month of ``ts``, replacing only the months that ``df`` has rows of."""
    by_month = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    # All rows of a month in a few tasks, not in one: a month may hold most of the orders.
    spread = by_month.withColumn("__place", F.pmod(F.xxhash64(*df.columns), F.lit(8))).repartition("month", "__place").drop("__place")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
