"""Near-duplicates by SimHash: popcounts of segments as an embedding, joined on a grid below a Manhattan distance.

Fingerprints are cut into segments of two bits, and each segment is mapped to its number of set bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. With the bits of every segment
sorted (a unary code of its count) that distance is the number of differing bits of the two codes. The 32 axes form
eight groups of four; a Manhattan distance of four changes four groups at most, so close vectors have the same
coordinates in at least four groups and meet in one of the 70 grids that four groups span. Inside a grid cell the
Manhattan bound is tested first and the fingerprints after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled, with_text_columns

GROUPS = 8
#: A cell with more fingerprints is worked on in pairs of blocks of this size.
BLOCK = 1 << 20
#: Cells up to this size are compared by shifting the sorted rows; larger ones by breadth-first search.
SMALL = 8


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed number; 0 for a text without words."""
    if not text:
        return 0
    # bytes.lower() maps A-Z alone, bytes.split() cuts at the space and 9-13.
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of `docs`; other columns are not read. A null or wordless text has
    fingerprint 0."""

    def make():
        return lambda texts, _: [[fingerprint(t, words, seed) for t in texts]]

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return with_text_columns(slim, "fp bigint", make).drop("text")


def unary_code(fps: np.ndarray) -> np.ndarray:
    """Both bits of every two-bit segment sorted: the segments' popcounts in unary."""
    x = fps.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    pair = (x >> np.uint64(1)) & low
    return ((x & low) | pair) | (((x & low) & pair) << np.uint64(1))


def grid_cells(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """For each grid, the cell of every fingerprint."""
    octets = unary_code(fps).view(np.uint8).reshape(-1, GROUPS).astype(np.int64)
    for grid, chosen in enumerate(combinations(range(GROUPS), GROUPS - distance)):
        cell = np.full(len(fps), grid, np.int64)
        for g in chosen:
            # Four popcounts of 0 to 2 are one of 81 values, and 70 * 81 ** 4 is below 2 ** 63 by far.
            cell = cell * 256 + octets[:, g]
        yield cell


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most `distance` connect among distinct `fps`: a breadth-first forest."""
    links: list[tuple[int, int]] = []
    rest, codes = fps.view(np.uint64), unary_code(fps)
    queue: list[tuple[np.uint64, np.uint64]] = []
    while len(rest):
        if not queue:
            queue.append((rest[0], codes[0]))
            rest, codes = rest[1:], codes[1:]
        own, code = queue.pop()
        near = np.flatnonzero(np.bitwise_count(codes ^ code) <= distance)
        near = near[np.bitwise_count(rest[near] ^ own) <= distance]
        if len(near):
            one = int(np.uint64(own).view(np.int64))
            links += [(one, int(x)) for x in rest[near].view(np.int64)]
            queue += list(zip(rest[near], codes[near], strict=True))
            keep = np.ones(len(rest), bool)
            keep[near] = False
            rest, codes = rest[keep], codes[keep]
    return links


def cell_links(cells: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links within the cells of rows sorted by cell, without those that others imply within a small cell."""
    edge = np.flatnonzero(np.diff(cells)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    large = sizes > SMALL
    for s, n in zip(starts[large], sizes[large], strict=True):
        yield from spanning_links(fps[s : s + n], distance)
    few = np.repeat((sizes > 1) & ~large, sizes)
    cells, fps = cells[few], fps[few]
    codes, raw = unary_code(fps), fps.view(np.uint64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for k in range(1, SMALL):
        if len(cells) <= k:
            break
        near = np.flatnonzero((cells[k:] == cells[:-k]) & (np.bitwise_count(codes[k:] ^ codes[:-k]) <= distance))
        near = near[np.bitwise_count(raw[near] ^ raw[near + k]) <= distance]
        for a, b in zip(fps[near].tolist(), fps[near + k].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[x] = y
                yield a, b


def near_links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct `fp` within `distance` bits.

    Cells are dealt out by a shuffle, and a task reads them sorted, one after the other. A cell of more than `block`
    fingerprints is split: every pair of its blocks is a task's group of its own, so no group exceeds two blocks.
    """

    if not 0 <= distance < GROUPS:
        raise ValueError("distance must be between 0 and 7")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for cell in grid_cells(fps, distance):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps)], names=["cell", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            found = list(cell_links(keys, fps, distance))
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, i, j, fps = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            new = np.concatenate(([True], (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
            last = held[-1][0][-1] if held else None
            first = last is not None and (cell[0], i[0], j[0]) == tuple(last)
            keys = np.stack((cell, i, j), axis=1)
            cut = len(new) - 1 - int(np.argmax(new[::-1]))  # where the last group of the batch begins
            if first and cut == 0:
                held.append((keys, fps))
                continue
            keys_all = np.concatenate([k for k, _ in held] + [keys[:cut]])
            fps_all = np.concatenate([x for _, x in held] + [fps[:cut]])
            if len(fps_all):
                change = np.any(np.diff(keys_all, axis=0) != 0, axis=1)
                yield done(np.concatenate(([0], np.cumsum(change))), fps_all)
            held = [(keys[cut:], fps[cut:])]
        if held:
            keys_all = np.concatenate([k for k, _ in held])
            change = np.any(np.diff(keys_all, axis=0) != 0, axis=1)
            yield done(np.concatenate(([0], np.cumsum(change))), np.concatenate([x for _, x in held]))

    cells = distinct.select("fp").mapInArrow(place, "cell bigint, fp bigint")
    if distinct.count() > block:
        large = (
            cells.groupBy("cell")
            .count()
            .where(F.col("count") > block)
            .select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        )
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = (
            cells.join(large, "cell", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        )
    else:
        cells = cells.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    dealt = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(match, "a bigint, b bigint")


def linked(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) for every distinct fingerprint: equal roots where links of at most `distance` bits lead."""
    distinct = settled(prints.select("fp").distinct())
    groups = components(near_links(distinct, distance))
    return distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) for every row.

    Rows with a null doc_id belong to components but never name them; a component without any id has a null
    component_id. Repeated rows are returned as often as they occur. An empty table gives an empty result.
    """
    prints = settled(fingerprints(docs, words, seed))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(linked(prints, distance), "fp")
    names = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = firsts.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """One row of `docs` for each component: that with the smallest doc_id, null ids last.

    Of rows that share that id, the one whose text has the smallest hash stays; of rows that share the text as well,
    any one.
    """
    prints = settled(fingerprints(docs, words, seed))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = prints.groupBy("fp").agg(F.min(order).alias("least"))
    least = least.join(linked(prints, distance), "fp").groupBy("root").agg(F.min("least").alias("least"))
    chosen = settled(least.select(F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash")))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    repeated = settled(
        prints.groupBy("doc_id", "text_hash").count().where(F.col("count") > 1)
        .join(chosen, same & (F.col("text_hash") == F.col("__hash")), "left_semi")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    )
    names = docs.columns
    same = same & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(chosen, same, "left_semi")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same, "left_semi").withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    return kept.join(repeated, same, "left_anti").union(again.select(*names))
