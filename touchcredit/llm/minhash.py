"""Near-duplicates by circulant MinHash, banding and an exact check of word-shingle sets.

A permutation of the 32-bit universe breaks up the shingles' order; a second one, shifted by 1 to K places in a circle,
gives all K coordinates of a signature. Bands of coordinates make buckets. Copies (equal sets) are one node from the start.

In a bucket, two bounds that lose nothing come before the texts are compared: the sizes, and the differing bits of two
parity bitmaps, which never exceed the sets' symmetric difference. Buckets are worked on in blocks: each block proposes a
spanning forest, nearest pairs first, of what the bounds allow, and the proposals are checked on the full sets, those of a
few bands first and of the others only what these have not connected. Then rows that are still outside their bucket's largest component are held against
the whole bucket, block by block, until no pair that the bounds allow between two components is left unchecked. So links
are missed only by banding (seven in ten million at the very threshold), and no group's pairs are ever all produced.
"""

from __future__ import annotations

from base64 import b85encode
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, new_folder, settled, sorted_groups, tidy, with_text_columns

BANDS, ROWS = 30, 6
#: Proposals of so many bands are checked first; of the others, those between components that are left.
FIRST_WAVE = 3
#: Rows of a bucket that are compared with each other in one group, and stray rows held against such a block at a time.
BLOCK, STRAYS = 256, 64
#: Partners that a stray row may propose in a block: first, and by how much more in every further round.
PARTNERS, MORE = 2, 16



def shingles(text: str | None, words: int = 3) -> set[bytes]:
    """The distinct word shingles: A-Z in lower case, words cut at the space and 9-13; too few words are one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return set()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def _scramble(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of 64-bit hashes: minima of the second permutation, shifted by 1 to `size` places."""
    places = _scramble((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(1, size + 1, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 512):
        shifted = places[i : i + 512, None] + shifts
        np.minimum(least, _scramble(shifted, 0x21F0AAAD, 0x735A2D97).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for every band of every signature; keys of different bands differ as well."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for i in range(rows):
        key = (key ^ parts[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each of at least twice as many places as there are hashes: set where an odd number of them falls."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, text_bytes, n_shingles, node, bands, bits) for every row; equal sets have equal nodes, an empty
    set has a null one."""

    def make():
        digest, whole = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest

        def compute(texts: list, _: dict) -> list[list]:
            counts, nodes, bitmaps, signatures = [], [], [], []
            for text in texts:
                found = shingles(text, words)
                hashes = np.unique(np.fromiter((digest(s) for s in found), np.uint64, len(found)))
                counts.append(len(found))
                nodes.append(b85encode(whole(hashes.tobytes())).decode() if found else None)
                bitmaps.append(parity_bitmap(hashes) if found else None)
                signatures.append(signature(hashes))
            keys = band_keys(np.array(signatures)).tolist() if texts else []
            return [counts, nodes, [k if n else None for k, n in zip(keys, nodes, strict=True)], bitmaps]

        return compute

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("text_bytes"))
    return with_text_columns(slim, "n_shingles bigint, node string, bands array<bigint>, bits binary", make).drop("text")


def may_link(one: tuple[int, int, int], other: tuple[int, int, int], percent: int) -> int | None:
    """A lower bound of the symmetric difference of two sets, (size, bitmap, its bits) each, if they may be similar enough."""
    (n, x, wide), (m, y, other_wide) = one, other
    if 100 * min(n, m) < percent * max(n, m):
        return None
    while wide > other_wide:
        wide >>= 1
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    while other_wide > wide:
        other_wide >>= 1
        y = (y >> other_wide) ^ (y & ((1 << other_wide) - 1))
    apart = (x ^ y).bit_count()
    return apart if (100 + percent) * (n + m - apart) >= 2 * percent * (n + m) else None


def _sketch(n: int, bits: bytes) -> tuple[int, int, int]:
    return n, int.from_bytes(bits, "little"), 8 * len(bits)


def block_forest(rows: list[tuple], percent: int) -> list[tuple[str, str, int]]:
    """Nearest-first spanning forest (a, b, band) of the pairs that may link, over a band's rows (node, n, bits, band)."""
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = [(node, _sketch(n, bits)) for node, n, bits, _ in rows]
    pairs = []
    for i, (node, sketch) in enumerate(kept):
        for other, its_sketch in kept[:i]:
            if (apart := may_link(sketch, its_sketch, percent)) is not None:
                pairs.append((apart / (sketch[0] + its_sketch[0]), min(node, other), max(node, other)))
    links = []
    for _, a, b in sorted(pairs):
        if (x := top(a)) != (y := top(b)):
            parent[x] = y
            links.append((a, b, rows[0][3]))
    return links


def stray_partners(rows: list[tuple], percent: int, most: int) -> Iterator[tuple[str | None, str | None, int]]:
    """For each stray of rows (node, root, n, bits, side) its nearest `most` partners of other components that may link.

    Side 0 is the bucket's block, side 1 its strays. A pair of nulls says that a stray had more of them.
    """
    block = [(node, root, _sketch(n, bits)) for node, root, n, bits, side in rows if side == 0]
    for node, root, n, bits, side in rows:
        if side == 1:
            own = _sketch(n, bits)
            near = sorted(
                (apart, other) for other, its, sketch in block if its != root and (apart := may_link(own, sketch, percent)) is not None
            )
            yield from ((min(node, other), max(node, other), 0) for _, other in near[:most])
            if len(near) > most:
                yield None, None, 0


def _by_group(df: DataFrame, keys: list[str], fields: list[str], work) -> DataFrame:
    """Pairs (a, b, band) that `work` makes of every group's rows. Groups are dealt out by a shuffle and read one by one."""
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("band", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in sorted_groups(batches, len(keys)):
            found += work(rows)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    dealt = df.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a string, b string, band int").groupBy("a", "b").agg(F.min("band").alias("band"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; `texts` has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(partial(shingles, words=words))
        for batch in batches:
            sure = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = sets(one), sets(other)
                both = len(x & y)
                sure.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a string, b string")


class _Search:
    """Links between nodes, wave by wave; every wave's pairs, links and components are tables in the shared folder."""

    def __init__(self, docs: DataFrame, marks: DataFrame, percent: int, words: int):
        self.docs, self.percent, self.words = docs, percent, words
        self.sets = settled(
            marks.where("node is not null")
            .groupBy("node")
            .agg(*(F.first(c).alias(c) for c in ("n_shingles", "bits", "bands")), F.min(F.struct("text_hash", "text_bytes")).alias("source"))
        )
        keyed = self.sets.select("node", F.posexplode("bands").alias("band", "key"))
        many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        self.buckets = settled(keyed.join(many, "key"))
        tidy(docs.sparkSession)
        self.texts: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.roots: DataFrame | None = None

    def rooted(self, rows: DataFrame, node: str, root: str) -> DataFrame:
        """`rows` with the root of a node's component, the node itself while it has no link."""
        if self.roots is None:
            return rows.withColumn(root, F.col(node))
        its = self.roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return rows.join(its, node, "left").withColumn(root, F.coalesce(root, node))

    def proposed_in_blocks(self) -> DataFrame:
        rows = self.buckets.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("members") / BLOCK)))
        rows = rows.join(self.sets.select("node", "n_shingles", "bits"), "node")
        percent = self.percent
        return _by_group(rows, ["key", "block"], ["node", "n_shingles", "bits", "band"], lambda group: block_forest(group, percent))

    def proposed_by_strays(self, most: int) -> DataFrame:
        """Pairs of buckets that hold more than one component, between a row outside the largest one and any other row."""
        rows = self.rooted(self.buckets, "node", "root")
        sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        host = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("host"), (F.sum("size") - F.max("size")).alias("outside"))
        rows = settled(rows.join(host.where("outside > 0"), "key").join(self.sets.select("node", "n_shingles", "bits"), "node"))
        blocks, parts = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("outside") / STRAYS).cast("int")
        spread = F.xxhash64("node", "key")
        block = rows.withColumns({"side": F.lit(0), "block": F.pmod(spread, blocks).cast("int"), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
        stray = rows.where("root <> host").withColumns(
            {"side": F.lit(1), "part": F.pmod(spread, parts).cast("int"), "block": F.explode(F.sequence(F.lit(0), blocks - 1))}
        )
        percent, fields = self.percent, ["node", "root", "n_shingles", "bits", "side"]
        both = block.select("key", "block", "part", *fields).union(stray.select("key", "block", "part", *fields))
        return _by_group(both, ["key", "block", "part"], fields, lambda group: list(stray_partners(group, percent, most)))

    def fetch(self, pairs: DataFrame) -> None:
        """One text of every node of `pairs` is kept at hand; texts are looked up in the documents once, by their hashes."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.texts is not None:
            nodes = settled(nodes.join(self.texts, "node", "left_anti"))
            if nodes.isEmpty():
                return
        needed = self.sets.join(nodes, "node").select("node", F.col("source.text_hash").alias("__hash"), F.col("source.text_bytes").alias("__bytes"))
        same = (F.xxhash64("text") == F.col("__hash")) & (F.octet_length("text") == F.col("__bytes"))
        found = self.docs.select("text").join(needed, same).select("node", "text").dropDuplicates(["node"])
        folder = new_folder(self.docs.sparkSession, "texts")
        found.write.parquet(folder)
        found = self.docs.sparkSession.read.schema("node string, text string").parquet(folder)
        self.texts = found if self.texts is None else self.texts.union(found)

    def check(self, pairs: DataFrame) -> bool:
        """Checks pairs between different components on their full sets, and merges what links; whether any did."""
        rows = self.rooted(self.rooted(pairs, "a", "root_a"), "b", "root_b").where("root_a <> root_b").select("a", "b")
        links = settled(confirmed(rows, self.texts, self.percent, self.words))
        tidy(self.docs.sparkSession)
        if links.isEmpty():
            return False
        ends = self.rooted(self.rooted(links, "a", "root_a"), "b", "root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        merged = components(ends, apart=True).select(F.col("node").alias("root"), F.col("root").alias("new"))
        tidy(self.docs.sparkSession)
        if self.roots is None:
            self.roots = settled(merged.toDF("node", "root"))
            return True
        # A component keeps its rows; its root is looked up. Nodes that had no link yet are among the new roots' nodes.
        moved = self.roots.join(merged, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = merged.toDF("node", "root").join(self.roots.select("node"), "node", "left_anti")
        self.roots = settled(moved.union(fresh))
        return True

    def propose_strays(self, most: int) -> tuple[bool, bool]:
        """Checks what strays newly propose; whether anything linked, and whether they had more to propose."""
        found = settled(self.proposed_by_strays(most))
        more = not found.where("a is null").isEmpty()
        new = found.where("a is not null").select("a", "b")
        if self.tested is not None:
            new = settled(new.join(self.tested, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return False, more
        self.fetch(new)
        self.tested = new if self.tested is None else self.tested.union(new)
        return self.check(new), more

    def run(self) -> DataFrame | None:
        """(node, root) of the linked nodes."""
        proposed = settled(self.proposed_in_blocks())
        if proposed.isEmpty():
            return None
        self.fetch(proposed)
        self.check(proposed.where(F.col("band") < FIRST_WAVE))
        self.check(proposed.where(F.col("band") >= FIRST_WAVE))
        self.tested = proposed.select("a", "b")
        # While nothing links, strays propose what they did before, and more only if they had more.
        most, open_still = PARTNERS, True
        while open_still:
            linked, more = self.propose_strays(most)
            open_still, most = linked or more, most * MORE
        return self.roots


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id) for every row.

    Rows link where their sets of distinct word shingles share at least `percent` of their union. A null text, an empty one
    and one without words have an empty set and link with nothing: each is its own component. Rows with a null doc_id belong
    to components but never name them and are not kept; a component without any id has a null component_id. Repeated rows
    are returned as often as they occur. Other columns are not read; an empty table gives an empty result. Equal sets are
    recognised by 128-bit digests of their shingles' 64-bit hashes; links between different sets are checked on the words.
    """
    marks = settled(prints(docs, words))
    roots = _Search(docs, marks, percent, words).run()
    firsts = marks.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    if roots is not None:
        firsts = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        names = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = firsts.join(names, "root").select("node", "component_id")
    else:
        named = firsts.withColumnRenamed("first_id", "component_id")
    found = marks.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


#: The same rows in DuckDB SQL, by counting the shingles that documents share.
SQL = r"""
WITH RECURSIVE parts AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM parts
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id
),
links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common >= 85 * (p.n + q.n - common)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""
