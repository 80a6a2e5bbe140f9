"""First appearances of customers kept between runs and merged batch by batch."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import Known, first_appearances

MANIFEST = "seq bigint, version string, batch string"
PAIRS = "customer_email string, email_lob string, created_date timestamp_ntz, listed boolean"


class KnownState:
    """The folder of the state. A batch is merged once, by its id; it reads the state and its own rows, no earlier orders.

    A version is a whole table of pairs of keys. A row of the manifest names it and its batch, and is the switch: a merge that
    dies before it changes nothing and can be repeated. One merge runs at a time.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.directory}/manifests")
        except AnalysisException:  # nothing was merged yet
            return self.spark.createDataFrame([], MANIFEST)

    def _pairs(self) -> tuple[int, DataFrame]:
        last = self._manifests().orderBy(F.desc("seq")).first()
        if last is None:
            return 0, self.spark.createDataFrame([], PAIRS)
        return last.seq, self.spark.read.schema(PAIRS).parquet(f"{self.directory}/versions/{last.version}")

    def merge(self, batch: str, orders: DataFrame | None = None, history: DataFrame | None = None) -> bool:
        """Take in a batch of enriched orders, of listed customers, or of both; False if the batch is in already."""
        if not self._manifests().where(F.col("batch") == batch).isEmpty():
            return False
        seq, rows = self._pairs()
        keys = ["customer_email", "email_lob"]
        if orders is not None:
            rows = rows.unionByName(orders.select(*keys, "created_date", F.lit(False).alias("listed")))
        if history is not None:
            none = F.lit(None).cast("timestamp_ntz").alias("created_date")
            rows = rows.unionByName(history.select(*keys, none, F.lit(True).alias("listed")))
        merged = rows.groupBy(*keys).agg(F.min("created_date").alias("created_date"), F.max("listed").alias("listed"))
        version = uuid.uuid4().hex
        merged.write.parquet(f"{self.directory}/versions/{version}")
        row = self.spark.createDataFrame([(seq + 1, version, batch)], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.directory}/manifests")
        return True

    def known(self) -> Known:
        """First appearances for :func:`~touchcredit.operators.flag_new`, for any cut-off."""
        return first_appearances(self._pairs()[1])
