import numpy as np
import pytest

from touchcredit.llm.registry import QUERIES
from touchcredit.llm.whitening import Spectrum, exact_deviation, secular_update, whitened

SF = "/root/testdata/sf0.001"


def brute(x, k=8):
    """Whitened rows up to sign, eigenvalues' shares, deviations."""
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [i for i in range(min(k, len(values))) if values[i] > 1e-9 * values.sum()]
    w = y @ vectors[:, keep] / np.sqrt(values[keep])
    return w, values[keep] / values.sum(), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def close(rows, x, ids):
    want, shares, deviations = brute(x)
    place = {int(v): i for i, v in enumerate(ids)}
    got = np.full(want.shape, np.nan)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(x) and r.deviation == deviations[place[r.vec_id]]
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert len(rows) == want.size and np.abs(got * signs - want).max() < 1e-7


def spread(rng, n, d):
    return np.floor(rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d)) * 90 + 1e5)


@pytest.mark.parametrize("kind", ["full", "few", "bits", "repeated", "equal pairs"])
def test_updates_equal_a_whole_decomposition(kind):
    rng = np.random.default_rng(3)
    x = {
        "full": spread(rng, 200, 20),
        "few": spread(rng, 9, 20),
        "bits": rng.integers(0, 2, (300, 12)).astype(float),
        "repeated": np.repeat(spread(rng, 15, 10), 7, axis=0),
        "equal pairs": np.vstack([np.eye(6), -np.eye(6)]) * 50,
    }[kind]
    d = x.shape[1]
    whole, one, other = Spectrum(d), Spectrum(d), Spectrum(d)
    for i, row in enumerate(x):
        whole.add(row)
        (one if i % 3 else other).add(row)
    one.merge(other)
    weighted = Spectrum(d)
    for row, times in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
        weighted.add(row, int(times))
    y = x - x.mean(axis=0)
    scatter = y.T @ y
    for s in (whole, one, weighted):
        assert s.n == len(x) and np.abs(s.mean - x.mean(axis=0)).max() < 1e-6
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-10 * np.trace(scatter)


def test_deflation_leaves_what_is_not_touched():
    values, vectors = np.array([1.0, 2.0, 2.0, 5.0]), np.eye(4)
    new, turned = secular_update(values, vectors, np.array([0.0, 3.0, 4.0, 0.0]), 1.0)
    assert np.allclose(new, [1, 2, 5, 27]) and np.allclose(np.abs(turned[:, 3]), [0, 0.6, 0.8, 0])
    assert np.array_equal(secular_update(values, vectors, np.zeros(4), 1.0)[0], values)


def test_query_equals_brute_force(spark):
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([np.floor(np.array(r.embedding, float) * 1024) + 100_000 for r in table])
    close(rows, x, [r.vec_id for r in table])


def test_many_partitions_and_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([spread(rng, 150, 12) / 1024, np.tile(spread(rng, 1, 12) / 1024, (75, 1))])
    df = spark.createDataFrame([(i, row.tolist(), "x") for i, row in enumerate(x)], "vec_id bigint, embedding array<double>, n string")
    close(whitened(df.repartition(13)).collect(), np.floor(x * 1024) + 100_000, range(len(x)))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (None, [0.0, 1.0]), (2, [3.0, 5.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [1.0, inf]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, whitened int")
    got = whitened(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted([(i, c) for i in ("1", "2", "2", "None") for c in (1, 2)])
    x = np.array([[1, 2], [3, 5], [0, 1], [3, 5]]) * 1024 + 100_000
    assert {r.deviation for r in got} == set(brute(x.astype(float))[2])
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_variation_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert whitened(df).count() == 0 and whitened(df.limit(0)).count() == 0 and whitened(df.limit(1)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {r.component for r in whitened(line).collect()} == {1}


def test_deviations_are_exact_or_null():
    assert exact_deviation(np.array([3, 5]), 4, np.array([7, 9])) == 25 + 121
    big = 1 << 30
    assert exact_deviation(np.array([big]), 3, np.array([0])) is None
    assert exact_deviation(np.array([big + 1]), 2, np.array([0])) == (2 * (big + 1)) ** 2
