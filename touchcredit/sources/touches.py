"""Email open lists as one long table ``campaign, recipient, sent_at, clicked``."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import parse_time
from .headers import normalise_headers
from .tables import read_table


#: Headers of lists that are read at once.
HEADERS_AT_ONCE = 16


def tidy_touches(df: DataFrame, campaign) -> DataFrame:
    """Normalise one or many lists; ``campaign`` is a column giving each row's campaign."""
    named = normalise_headers(df).withColumnsRenamed(C.TOUCH_COLUMNS)
    sent = F.col("sent_at")
    is_text = named.schema["sent_at"].dataType.simpleString() == "string"
    if is_text:
        sent = parse_time(sent)
    else:
        sent = sent.cast("timestamp_ntz")
    clicked = F.col("clicked").cast("boolean") if "clicked" in named.columns else F.lit(None).cast("boolean")
    columns = [
        campaign.alias("campaign"),
        F.lower("recipient").alias("recipient"),
        sent.alias("sent_at"),
        clicked.alias("clicked"),
    ]
    if not is_text:
        return named.select(*columns)
    # Behind a generator a time is read once for a row, and not again in every condition on it.
    return named.select(F.inline(F.array(F.struct(*columns))))


def read_open_list(spark: SparkSession, path: str, campaign: str, fmt: str = "csv") -> DataFrame:
    """One open list under a given campaign name."""
    return tidy_touches(read_table(spark, path, fmt), F.lit(campaign))


def _ending(path: Column) -> Column:
    """The folder and the file's name at the end of a path as ``_metadata`` has it, percent-encoded."""
    return F.substring_index(path, "/", -2)


def _list_files(spark: SparkSession, directory: str, fmt: str) -> DataFrame:
    """``path`` of every file below the directory, with the file's own name, its folder's, and both as a scan gives them.

    Only names are read here, no contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "_metadata.file_path")
    parts = F.split("path", "/")
    return files.select(
        "path",
        _ending(F.col("file_path")).alias("ending"),
        F.regexp_replace(F.element_at(parts, -1), rf"\.{fmt}$", "").alias("file_name"),
        F.element_at(parts, -2).alias("folder_name"),
    )


def read_touches(spark: SparkSession, directory: str, campaign_table: DataFrame, fmt: str = "csv") -> DataFrame:
    """All open lists named by the index.

    A list is ``<long_name>.<fmt>`` or a folder ``<long_name>/``; a file belongs to its folder if the index names the
    folder. Each list is read by the names of its own columns, so lists may differ in their other columns and in
    whether they state clicks: there is one scan for each distinct header, not for each list. A list that the index
    names and the directory does not hold is an error; files that the index does not name are left out.

    The driver holds the index and the lists' file names, a row for each mailed campaign.
    """
    named = [(r["long_name"], r["campaign"]) for r in campaign_table.select("long_name", "campaign").collect()]
    by_name: dict[str, list[str]] = {}
    for long_name, campaign in named:
        by_name.setdefault(long_name, []).append(campaign)
    paths: dict[str, list[str]] = {}
    folders: dict[str, str] = {}  # as the scan gives them, of lists that are folders; files that are lists themselves
    files: dict[str, str] = {}
    for r in _list_files(spark, directory, fmt).collect():
        found = r["folder_name"] if r["folder_name"] in by_name else r["file_name"]
        if found in by_name:
            paths.setdefault(found, []).append(r["path"])
            folder, file = r["ending"].rsplit("/", 1)
            if found == r["folder_name"]:
                folders[folder] = found
            else:
                files[file] = found
    missing = sorted(set(by_name) - set(paths))
    if missing:
        raise FileNotFoundError(f"no {fmt} file for the lists {', '.join(missing)} in {directory}")

    by_header: dict[tuple, list[str]] = {}
    every = [path for own in paths.values() for path in own]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:  # each header is a small job that waits more than it works
        schemas = list(pool.map(lambda path: read_table(spark, _escaped(path), fmt).schema, every))
    for path, schema in zip(every, schemas, strict=True):
        by_header.setdefault(tuple((f.name, f.dataType.simpleString()) for f in schema), []).append(path)
    several = [name for name, campaigns in by_name.items() if len(campaigns) > 1]
    if several:
        raise ValueError(f"the index names the lists {', '.join(sorted(several))} more than once")
    out = None
    for own in by_header.values():
        # A row's list is found by the name of its folder or file, of which there are as many as lists, whatever the files.
        ending = _ending(F.col("_metadata.file_path"))
        named_by = [(folders, F.substring_index(ending, "/", 1)), (files, F.substring_index(ending, "/", -1))]
        found = [
            F.element_at(F.create_map(*(F.lit(x) for own_name, name in names.items() for x in (own_name, by_name[name][0]))), part)
            for names, part in named_by if names
        ]
        campaign = F.coalesce(*found)
        lists = read_table(spark, [_escaped(p) for p in own], fmt).withColumn("__campaign", campaign)
        one = tidy_touches(lists, F.col("__campaign"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "campaign string, recipient string, sent_at timestamp_ntz, clicked boolean")


def _escaped(path: str) -> str:
    """A path as readers take it, with the characters of patterns taken literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
