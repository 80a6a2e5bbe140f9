"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into source buckets by a hash. For each bucket the number of its rows that go to each shard is drawn
from the hypergeometric law of a uniform permutation, given what the shards still lack. Inside a bucket the rows are
permuted and cut at these counts, exchanged to their shards, and permuted again there. Every shard then has exactly
its size, every row is as likely in any place, and no step holds more than a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a source bucket, or a part of a shard, holds on average.
BUCKET_ROWS = 20_000
#: Buckets whose counts are drawn in one task, from those of their group; the groups' are drawn on the driver.
GROUP = 1024
#: numpy draws hypergeometric numbers below this many items.
NUMPY_ITEMS = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items, taken without replacement, are among the `good` ones."""
    if good + bad < NUMPY_ITEMS:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * good / total
    spread = math.sqrt(mean * max(bad, 1) / total * max(total - draws, 1) / (total - 1))
    first, last = max(low, math.floor(mean - 40 * spread - 40)), min(high, math.ceil(mean + 40 * spread + 40))
    # Ratios of neighbouring probabilities, outward from the first; mass beyond 40 deviations is below 1e-300.
    k = np.arange(first, last, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(ratio)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(counts: list[int], targets: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows of each bucket that go to each shard: row sums are `counts`, column sums `targets`."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = list(targets)
    matrix = np.zeros((len(counts), len(targets)), np.int64)
    for b, n in enumerate(counts):
        for s in range(len(targets)):
            rest = sum(left[s + 1 :])
            take = hypergeometric(rng, left[s], rest, n) if rest else n
            matrix[b, s] = take
            left[s] -= take
            n -= take
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1, counts at most one apart) and `slot` (a place in it, gapless from 0).

    Places depend on the rows' values and the seed alone, so a task that is run again gives the same. Equal rows are
    interchangeable; they share a bucket. Columns of the input named shard or slot are replaced; nulls are values
    like any other. The communication matrix is drawn as a tree: on the driver for groups of GROUP buckets, a row of counts
    for each twenty million rows, and in tasks for the buckets of a group, from the group's own counts for every shard.
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns
    key = F.struct(*(F.col(f"`{c}`") for c in names))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    own = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int"))
    counts = own.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__group", F.floor(F.col("__bucket") / GROUP).cast("int"))
    groups = sorted((r["__group"], r["n"]) for r in counts.groupBy("__group").agg(F.sum("__n").alias("n")).collect())
    matrix = communication_matrix([n for _, n in groups], even_sizes(total, shards), seed)
    of_group = rows.sparkSession.createDataFrame(
        [(g, line) for (g, _), line in zip(groups, matrix.tolist(), strict=True)], "__group int, __to array<bigint>"
    )

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__bucket")
        own = communication_matrix(frame["__n"].tolist(), list(frame["__to"].iloc[0]), [seed, int(frame["__group"].iloc[0])])
        return pd.DataFrame({"__bucket": frame["__bucket"], "__ends": np.cumsum(own, axis=1).tolist()})

    ends = counts.join(of_group, "__group").groupBy("__group").applyInPandas(draw, "__bucket int, __ends array<bigint>")
    first = Window.partitionBy("__bucket").orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    dealt = (
        own.withColumn("__at", F.row_number().over(first) - 1)
        .join(ends, "__bucket")
        .withColumn("shard", F.aggregate("__ends", F.lit(0), lambda n, end: n + (F.col("__at") >= end).cast("int")))
    )
    # The second permutation: a part of the shard at random, a place in the part at random.
    parts = max(1, -(-total // (shards * bucket_rows)))
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 2), key), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__part").count()
    offsets = offsets.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    second = Window.partitionBy("shard", "__part").orderBy(F.xxhash64(F.lit(seed + 3), key), key, "__at")
    return (
        dealt.withColumn("__rank", F.row_number().over(second) - 1)
        .join(offsets, ["shard", "__part"])
        .withColumn("slot", (F.col("__before") + F.col("__rank")).cast("long"))
        .select(*(F.col(f"`{c}`") for c in names), "shard", "slot")
    )


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Every document's place by the `rows` law: counts at most one apart.

    size is the text's UTF-8 bytes plus 1, text_crc32 its CRC (a null text has no bytes: 1 and 0). grown_shard is
    null, as another shard count draws all places anew.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed = shuffle_into_shards(slim, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
