"""Benchmark decontamination: a broadcast set of test n-grams, scanned for in the word windows of whole documents.

Words are runs of ASCII digits, ASCII letters in either case, and non-ASCII characters, compared in lower case (A-Z
alone). A window is `n` consecutive words of a benchmark item; an item of fewer words is one window, an item of none
has no window. A document word inside any occurrence of a window is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled

#: Bytes that belong to words, after A-Z became a-z; in UTF-8 every byte of a non-ASCII character is above 127.
KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Benchmark text that one broadcast holds; more of it is broadcast in several blocks, one after the other.
BLOCK_BYTES = 64 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),  # [first, end) of hit words, merged
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),  # [first, end) of hit bytes, merged
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", pa.list_(pa.list_(pa.int64()))),
        ("spans", pa.list_(pa.list_(pa.int64()))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(KEPT).split() if text else []


@dataclass
class WindowSet:
    """Windows of a block of items: by length, their words' ids as bytes with the items they come from."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, dict[bytes, list[str]]] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], n: int) -> WindowSet:
        found = cls()
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([found.vocabulary.setdefault(w, len(found.vocabulary)) for w in words], np.int64)
            size = min(n, len(ids))
            names = found.windows.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                owners = names.setdefault(ids[i : i + size].tobytes(), [])
                if name is not None and name not in owners:
                    owners.append(name)
        for size, names in found.windows.items():
            table = np.frombuffer(b"".join(names), np.int64).reshape(-1, size)
            found.hashes[size] = np.unique(rolling(table.ravel(), np.arange(len(table)) * size, size))
        return found

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, end) of the hit words, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            own = rolling(ids, at, size)
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in at[hashes[place] == own].tolist():
                owners = self.windows[size].get(ids[i : i + size].tobytes())
                if owners is not None:  # equal words, not only an equal hash
                    items.update(owners)
                    hit[i] += 1
                    hit[i + size] -= 1
        inside = np.concatenate(([0], np.cumsum(hit) > 0)).astype(np.int8)
        step = np.diff(inside)
        return np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1)), axis=1).tolist(), items


def rolling(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` ids from each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * PRIME + ids[at + k].astype(np.uint64) + np.uint64(1)
    return out


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, column: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct `column`: n_words, merged word ranges, merged byte ranges (of the UTF-8 text), item ids.

    Null texts have no words; null items and items without words have no windows. An item without an id marks words
    but is not named. Repeated items count once, repeated documents each on their own. An empty benchmark hits
    nothing. A column of `docs` with the name of the new one is replaced.

    The benchmark's size is read first: a set up to `block_bytes` of text is one broadcast; a larger one goes through
    the documents in blocks of that size, and each block's hits are merged with those before.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    docs = docs.drop(column)
    names = docs.columns
    out = docs.withColumn(column, F.lit(None).cast(HITS))
    for k in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        windows = spark.sparkContext.broadcast(WindowSet.of([tuple(r) for r in own], n))

        def run(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            found = windows.value
            for batch in batches:
                result = []
                for value, before in zip(batch.column("text"), batch.column(column), strict=True):
                    text, earlier = value.as_py(), before.as_py()
                    words = words_of(text)
                    ranges, items = found.scan(words) if words else ([], set())
                    spans: list[list[int]] = []
                    if ranges:
                        flat = text.encode("utf-8", "surrogatepass").lower().translate(KEPT)
                        place = [m.span() for m in re.finditer(rb"\S+", flat)]
                        spans = [[place[a][0], place[b - 1][1]] for a, b in ranges]
                    if earlier:
                        ranges, spans = merged(ranges + earlier["words"]), merged(spans + earlier["spans"])
                        items |= set(earlier["items"])
                    result.append({"n_words": len(words), "words": ranges, "spans": spans, "items": sorted(items)})
                made = pa.array(result, HITS_ARROW)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, column])

        out = out.mapInArrow(run, out.schema)
        if k + 1 < blocks:
            out = settled(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "spans") -> DataFrame:
    """`docs` without contamination: `spans` cuts the hit ranges out of the texts, `documents` drops hit documents.

    A cut range takes its text with it and leaves one space where text is on both sides. Clean documents, null texts
    included, are returned as they are.
    """
    if action not in ("spans", "documents"):
        raise ValueError("action is spans or documents")
    hits = "__hits"
    found = contamination(docs, benchmark, n, hits)
    if action == "documents":
        return found.where(F.size(f"{hits}.spans") == 0).drop(hits)

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(value, ranges):
            if value is None or not len(ranges):
                return value
            raw, parts, at = value.encode("utf-8", "surrogatepass"), [], 0
            for a, b in [*ranges, (len(raw), len(raw))]:
                parts.append(raw[at:a].decode("utf-8", "surrogatepass").strip())
                at = int(b)
            return " ".join(p for p in parts if p)

        return text.combine(spans, one)

    return found.withColumn("text", cut("text", f"{hits}.spans")).drop(hits)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document; without items the digest of ''."""
    found = contamination(docs.select("doc_id", "text"), benchmark, n, "hits")
    hit = F.aggregate("hits.words", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH bench AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), starts AS (
    SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM bench WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM starts
), words AS (
    SELECT row_number() OVER () AS r, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
    SELECT p.r, p.i, s.size, x.item
    FROM places p JOIN sizes s ON p.i + s.size - 1 <= len(p.w)
    JOIN windows x ON x.size = s.size AND x.win = array_to_string(p.w[p.i:p.i + s.size - 1], ' ')
), hit AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM found) GROUP BY r
), items AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit h USING (r) LEFT JOIN items t USING (r)
"""
