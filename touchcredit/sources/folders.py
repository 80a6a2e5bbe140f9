"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``. A session on one machine that does not set it gets a folder of its own;
    any other is refused, because its executors could not read what the driver's machine holds."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="touchcredit-")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
