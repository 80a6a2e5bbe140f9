from collections import Counter

import numpy as np
import pytest

from touchcredit.llm.sharding import communication_matrix, even_sizes, hypergeometric, shard_digest, shuffle_into_shards


def test_matrix_has_both_margins():
    counts, targets = [10, 0, 7, 33, 1], even_sizes(51, 4)
    matrix = communication_matrix(counts, targets, 1)
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == targets
    assert (matrix >= 0).all() and (matrix == communication_matrix(counts, targets, 1)).all()


def test_matrix_follows_the_law():
    """Mean and variance of a cell over many draws are those of the hypergeometric law."""
    cells = np.array([communication_matrix([30, 70], [25, 75], s)[0, 0] for s in range(2000)])
    assert abs(cells.mean() - 7.5) < 0.2
    assert abs(cells.var() - 30 * 0.25 * 0.75 * 70 / 99) < 0.4


def test_large_numbers():
    rng = np.random.default_rng(0)
    draws = np.array([hypergeometric(rng, 3 * 10**9, 9 * 10**9, 1000) for _ in range(500)])
    assert abs(draws.mean() - 250) < 3 and abs(draws.std() - (1000 * 0.25 * 0.75) ** 0.5) < 2
    assert hypergeometric(rng, 10**10, 0, 7) == 7 and hypergeometric(rng, 0, 10**10, 7) == 0


def test_exact_sizes_and_places(spark):
    df = spark.range(1003).selectExpr("id", "id % 3 AS shard", "cast(null as string) AS slot", "id AS other")
    out = shuffle_into_shards(df, 16, bucket_rows=50)
    rows = out.collect()
    assert out.columns == ["id", "other", "shard", "slot"] and sorted(r.id for r in rows) == list(range(1003))
    places = Counter((r.shard, r.slot) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert [sizes[s] for s in range(16)] == even_sizes(1003, 16)
    assert set(places) == {(s, k) for s, n in sizes.items() for k in range(n)} and set(places.values()) == {1}
    assert sorted(rows) == sorted(shuffle_into_shards(df.repartition(7), 16, bucket_rows=50).collect())


def test_places_are_uniform(spark):
    """Over seeds, a row is in every shard and in both halves of it about as often."""
    df = spark.range(40).selectExpr("id")
    shards, halves = Counter(), Counter()
    for seed in range(12):
        for r in shuffle_into_shards(df, 4, seed, bucket_rows=7).collect():
            shards[r.id % 2, r.shard] += 1
            halves[r.id % 2, r.slot < 5] += 1
    assert all(30 < n < 90 for n in shards.values()) and all(80 < n < 160 for n in halves.values())


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_digest_of_odd_rows(spark, rows):
    texts = [(1, None), (1, None), (None, ""), (2, "é" * 1000), (3, "a")][:rows]
    got = shard_digest(spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id bigint, text string, shard int")).collect()
    assert len(got) == rows and all(r.law == "rows" and r.grown_shard is None for r in got)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t in texts)
    assert max(Counter(r.shard for r in got).values(), default=1) == 1


def test_matrix_as_a_tree(spark, monkeypatch):
    """Counts of a group's buckets are drawn from the group's: sizes stay exact, places uniform."""
    import touchcredit.llm.sharding as sharding

    monkeypatch.setattr(sharding, "GROUP", 3)
    df = spark.range(1003).selectExpr("id")
    rows = shuffle_into_shards(df, 16, bucket_rows=50).collect()
    sizes = Counter(r.shard for r in rows)
    assert [sizes[s] for s in range(16)] == even_sizes(1003, 16)
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}
    assert sorted(rows) == sorted(shuffle_into_shards(df.repartition(5), 16, bucket_rows=50).collect())
    shards = Counter()
    for seed in range(10):
        shards.update((r.id % 2, r.shard) for r in shuffle_into_shards(spark.range(40).selectExpr("id"), 4, seed, bucket_rows=5).collect())
    assert all(25 < n < 75 for n in shards.values())
