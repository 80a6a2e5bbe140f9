"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length, longest first. A query's k-th score over the longest candidates bounds from below
what a result must reach; in every other bucket that bound, divided by the query's length and the bucket's greatest
length, is the least cosine a candidate needs. Above one the bucket is skipped. Where the cosine is high, the range it
leaves for the query's largest coordinates prunes candidates; otherwise their own lengths do. What is left is
verified by full products in integers.

A task holds one bucket and reads the queries that ask for it one batch after the other, so candidates are moved once for
every quarter of a million queries, and queries once for every bucket that their bound leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Candidates in a bucket, which a task holds, and queries that a bucket is read by in one task.
BUCKET_ROWS = 16_384
QUERY_ROWS = 1 << 18
#: Longest candidates that give a query its first bound; the driver and every task hold them.
SEED_ROWS = 4096
#: Products that a task holds at a time.
PRODUCTS = 1 << 22
#: From this cosine on, a bucket prunes by coordinates; below, by length.
COORDINATE_COSINE = 0.7
FOCUS = 4
#: Products whose bound is below this are exact in doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, vec_id, v, norm): components as floor(scale * x), x as double; null vectors and those with null or non-finite
    components are left out, as are null ids. `row` tells rows apart that share everything else; the table is settled,
    so a row keeps it."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    kept = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(True)))
    made = kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), v.alias("v"))
    return settled(made.withColumn("norm", norm))


def products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return np.rint(q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


class Bucket:
    """Candidates (row, vec_id, v, norm) as one matrix for each dimension."""

    def __init__(self, candidates: pd.DataFrame):
        self.by_size = {
            size: (np.stack(own["v"].to_numpy()).reshape(len(own), size), *(own[c].to_numpy() for c in ("row", "vec_id", "norm")))
            for size, own in candidates.groupby(candidates["v"].map(len))
        }

    def scan(self, queries: pd.DataFrame, k: int) -> pd.DataFrame:
        """The best `k` for each query that pruning leaves; queries: row, vec_id, v, norm, least (null: unknown)."""
        found = []
        for size, own in queries.groupby(queries["v"].map(len)):
            if size in self.by_size:
                step = max(1, PRODUCTS // len(self.by_size[size][0]))
                for at in range(0, len(own), step):
                    found += scan_matrix(own.iloc[at : at + step], *self.by_size[size], k)
        return pd.concat(found, ignore_index=True) if found else best(0, 0, *(np.zeros(0, np.int64),) * 3, k)


def scan_matrix(queries: pd.DataFrame, c_all: np.ndarray, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: int) -> list[pd.DataFrame]:
    q_all = np.stack(queries["v"].to_numpy()).reshape(len(queries), c_all.shape[1])
    q_rows, q_ids, n_q = (queries[c].to_numpy() for c in ("row", "vec_id", "norm"))
    least = queries["least"].to_numpy(dtype=float)
    longest = norms.max()
    bound = float(n_q.max(initial=0) * longest)
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = least / (n_q * longest) - 1e-9  # the least cosine a candidate of this bucket needs
    open_ = ~(cosine > 1)
    by_coordinate = open_ & (cosine >= COORDINATE_COSINE)
    plain = np.flatnonzero(open_ & ~by_coordinate)
    if len(plain):
        # Length: candidates too short for even the least demanding of these queries are cut together.
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(least[plain] > 0, least[plain] / n_q[plain], 0)
        reach = norms >= np.nanmin(np.nan_to_num(needed)) * (1 - 1e-9)
        scores = products(q_all[plain], c_all[reach], bound)
        found += [best(q_rows[i], q_ids[i], rows[reach], ids[reach], scores[n], k) for n, i in enumerate(plain)]
    for i in np.flatnonzero(by_coordinate):
        # For unit vectors with q.c >= t, the angle of c to an axis is that of q within acos(t).
        unit = q_all[i] / n_q[i]
        keep = np.ones(len(ids), bool)
        t = cosine[i]
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            margin = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-6
            low = -1.0 if unit[f] < -t else unit[f] * t - margin
            high = 1.0 if unit[f] > t else unit[f] * t + margin
            part = np.clip(c_all[keep, f] / np.maximum(norms[keep], 1e-300), -1, 1)
            keep[np.flatnonzero(keep)[~((part >= low) & (part <= high))]] = False
        if keep.any():
            scores = products(q_all[i : i + 1], c_all[keep], bound)[0]
            found.append(best(q_rows[i], q_ids[i], rows[keep], ids[keep], scores, k))
    return found


def best(row: int, query: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of scores, without the query's own row; ties to smaller ids."""
    other = rows != row
    ids, scores = ids[other], scores[other]
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    n = len(order)
    return pd.DataFrame({"row": np.full(n, row), "query_id": np.full(n, query), "vec_id": ids[order], "score": scores[order]})


FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of `vectors` with the greatest inner product for each of `queries`.

    Both are (row, vec_id, v, norm) tables of `quantised`; queries are rows of `vectors`, or have rows of their own. A query
    is compared with every row but its own, also with others of its id. All candidates of its dimension are returned if
    they are fewer than `k`; ties go to the smaller id. Rows that repeat an id are candidates each, and queries that do
    have an answer each. Empty tables give an empty result.

    A bucket is a level of lengths five per cent wide, cut by a hash of the row into parts of about `bucket_rows` rows,
    so that equal vectors share no task. The driver holds the levels (bounded by the range of a double) and the SEED_ROWS
    longest vectors.
    """
    level = F.when(F.col("norm") > 0, F.floor(F.log("norm") / np.log(1.05))).otherwise(F.lit(-100_000)).cast("int")
    vectors = vectors.withColumn("level", level)
    levels = vectors.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()
    total = sum(x["n"] for x in levels)
    asked = queries.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not total or not asked:
        return empty
    parts = {x["level"]: -(-x["n"] // bucket_rows) for x in levels}
    blocks = -(-asked // query_rows)

    fields = ["row", "vec_id", "v", "norm"]
    longest = vectors.orderBy(F.col("norm").desc(), "vec_id", "row").limit(SEED_ROWS).select(*fields).toPandas()

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Bucket(longest)
        for frame in frames:
            near = seeds.scan(frame.assign(least=np.nan), k).groupby("row")["score"].agg(["size", "min"])
            near = near["min"].where(near["size"] >= k).astype(float)
            yield frame.assign(least=frame["row"].map(near).astype(float))

    bounded = queries.select(*fields).mapInPandas(bounds, "row bigint, vec_id bigint, v array<double>, norm double, least double")
    bounded = bounded.withColumn("least", F.nanvl("least", F.lit(None).cast("double")))
    buckets = F.array(
        *(
            F.struct(F.lit(x["level"]).alias("level"), F.lit(x["longest"]).alias("longest"), F.lit(parts[x["level"]]).alias("parts"))
            for x in levels
        )
    )
    # Length: a bucket whose longest candidate cannot reach the bound is not visited. Rounding is left some room.
    wanted = F.filter(
        buckets, lambda b: F.col("least").isNull() | (F.col("norm") * b["longest"] * 1.000001 + 1e-9 >= F.col("least"))
    )
    place = ["level", "part", "block"]
    ask = (
        bounded.withColumn("b", F.explode(wanted))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)))
        .withColumns({"level": F.col("b.level"), "block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "asks": F.lit(1)})
        .select(*place, "asks", *fields, "least")
    )
    count = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("level"))
    held = vectors.withColumns({"part": F.pmod(F.xxhash64(F.lit(5), "row"), count).cast("int"), "block": F.lit(0)})
    if blocks > 1:
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.select(*place, F.lit(0).alias("asks"), *fields, F.lit(None).cast("double").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept, bucket = None, [], None
        for batch in batches:
            frame = batch.to_pandas()
            change = (frame[[*place, "asks"]].diff().fillna(0) != 0).any(axis=1).cumsum()
            for _, rows in frame.groupby(change, sort=False):
                key = tuple(rows.iloc[0][place])
                if key != own:
                    own, kept, bucket = key, [], None
                if not rows.iloc[0]["asks"]:
                    kept.append(rows)
                elif kept or bucket:
                    bucket = bucket or Bucket(pd.concat(kept))
                    kept = []
                    yield pa.RecordBatch.from_pandas(bucket.scan(rows, k).astype("int64"), preserve_index=False)

    dealt = held.union(ask).repartition(*place).sortWithinPartitions(*place, "asks")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The query rows are those whose vec_id is divisible by `every`; all rows are candidates."""
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH vectors AS (
    SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.own, q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.own <> q.own AND len(c.v) = len(q.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
