"""Sinks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Keep = Callable[[str, DataFrame], DataFrame]


def lazily(title: str, df: DataFrame) -> DataFrame:
    """Keep nothing: tables built on this one compute it again."""
    return df


@dataclass
class ReportFolder:
    """A folder of tables. A report that is given :meth:`keep` writes each large table once, to its final place, and
    builds the tables that follow on what it reads back from there."""

    directory: str
    fmt: str = "parquet"
    paths: dict[str, str] = field(default_factory=dict)

    def write(self, title: str, df: DataFrame) -> str:
        """No table is forced into one file: report tables are small enough that adaptive execution leaves them in
        one partition, and order tables stay parallel."""
        path = f"{self.directory.rstrip('/')}/{re.sub(r'[^a-z0-9]+', '_', title.lower()).strip('_')}"
        writer = df.write.mode("overwrite").format(self.fmt)
        if self.fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        self.paths[title] = path
        return path

    def keep(self, title: str, df: DataFrame) -> DataFrame:
        """The table as written; text formats lose types, so there it is only written and not read back."""
        path = self.write(title, df)
        if self.fmt not in ("parquet", "orc"):
            return df
        return df.sparkSession.read.schema(df.schema).format(self.fmt).load(path)


def write_report(
    tables: Mapping[str, DataFrame], directory: str, fmt: str = "parquet", kept: ReportFolder | None = None
) -> dict[str, str]:
    """Write every table that ``kept`` has not written yet to its own folder below ``directory``; returns the folders."""
    folder = kept or ReportFolder(directory, fmt)
    for title, df in tables.items():
        if title not in folder.paths:
            folder.write(title, df)
    return {title: folder.paths[title] for title in tables}
