import math
import random

import numpy as np
import pytest

from touchcredit.llm.topk import quantised, top_k, top_k_of_embeddings

SCHEMA = "vec_id bigint, embedding array<float>, level string, v int"


def brute(rows, queries, k):
    own = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.append((i, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for at, (q, a) in enumerate(own):
        if q not in queries:
            continue
        others = [(i, b) for other, (i, b) in enumerate(own) if other != at and len(a) == len(b)]
        scores = sorted((-sum(s * t for s, t in zip(a, b, strict=True)), i) for i, b in others)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def make(seed, n, dim, spread):
    rng = random.Random(seed)
    base = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        size = math.exp(rng.gauss(0, spread))
        x = base if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, [size * (c + rng.gauss(0, 0.05) * (i % 3 > 0)) for c in x] if i % 5 else list(base)))
    return rows


@pytest.mark.parametrize(("seed", "dim", "spread"), [(1, 8, 0.0), (2, 8, 1.0), (3, 3, 2.0), (4, 64, 0.3)])
def test_equals_brute_force(spark, seed, dim, spread):
    """A third of the vectors are alike, and with buckets of 16 rows every way of pruning is taken."""
    rows = make(seed, 200, dim, spread)
    frame = spark.createDataFrame([(i, x, "l", 1) for i, x in rows], SCHEMA)
    own = quantised(frame)
    got = top_k(own, own.where("vec_id % 10 = 0"), 5, bucket_rows=16, query_rows=7)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(
        rows, {i for i, _ in rows if i % 10 == 0}, 5
    )


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [inf, 1.0]), (4, [nan, 0.0]), (5, [1.0]),
        (6, []), (None, [1.0, 1.0]), (100, [-1.0, 0.5]), (7, [3e4, -2e4]), (8, [0.001, -0.001]), (150, []), (200, [2.0]),
    ]
    frame = spark.createDataFrame([(i, x, "l", 1) for i, x in rows], SCHEMA)
    got = top_k_of_embeddings(frame).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, {0, 50, 100, 150, 200}, 5)
    assert top_k_of_embeddings(frame.limit(0)).count() == 0
    assert top_k_of_embeddings(frame.where("vec_id = 1 OR vec_id % 50 <> 0")).count() == 0


def test_repeated_ids(spark):
    """Every query row has an answer, and rows that share its id are candidates."""
    rows = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [1.0]), (50, [3.0]), (50, [3.0])]
    frame = spark.createDataFrame([(i, x, "l", 1) for i, x in rows], SCHEMA)
    got = top_k_of_embeddings(frame, 3).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, {0, 50}, 3)


def test_candidates_are_moved_once(spark):
    """No row is repeated for the queries' sake while these are one block."""
    frame = spark.createDataFrame([(i, x, "l", 1) for i, x in make(6, 120, 4, 0.5)], SCHEMA)
    own = quantised(frame)
    plan = top_k(own, own.where("vec_id % 2 = 0"), 5, bucket_rows=16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2  # the queries' buckets and their parts
    many = top_k(own, own.where("vec_id % 2 = 0"), 5, bucket_rows=16, query_rows=7)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, top_k(own, own.where("vec_id % 2 = 0"), 5).collect()))
