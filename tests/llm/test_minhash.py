import random

import numpy as np
import pytest

from touchcredit.llm import minhash
from touchcredit.llm.minhash import block_forest, may_link, near_duplicates, parity_bitmap, shingles, signature

DOCS = "doc_id bigint, text string, node string, key int"


def hashes(values):
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(str(v)) for v in values], np.uint64))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root(i)] = min(names.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), names.get(root(i)), d is not None and d == names.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS)
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng, copies=40):
    """Unrelated texts, and groups of copies edited around the threshold, so that some pairs link and some do not."""
    rows = []
    for length, edits in ((60, 2), (120, 3), (120, 4), (400, 8), (30, 1)):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        rows += [edited(rng, base, rng.randrange(edits + 1)) for _ in range(copies)]
    rows += [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingles():
    assert shingles("A b\x0bC  d") == {b"a b c", b"b c d"} and shingles("x Y") == {b"x y"}
    assert shingles(None) == shingles(" \t\n") == set() and shingles("É\xa0a b c") == {"É\xa0a b c".encode()}


def test_signatures_estimate_similarity():
    for share in (0.3, 0.6, 0.85):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = signature(hashes(range(n)), 900), signature(hashes(range(n - both, 2 * n - both)), 900)
        assert abs((a == b).mean() - share) < 0.06


def test_coordinates_are_shifts_of_one_permutation():
    """Coordinate k of one place is coordinate 1 of the place k - 1 further on."""
    one = np.arange(5, dtype=np.uint64)
    assert signature(one, 40)[:10].tolist() == signature(one, 10).tolist()
    assert len(set(signature(hashes([1]), 180).tolist())) == 180


def test_bounds_never_lose_a_link():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 300)
        own = set(rng.sample(range(10**6), n))
        other = set(rng.sample(sorted(own), max(1, int(n * rng.uniform(0.8, 1))))) | {-rng.randrange(10**6) for _ in range(rng.randrange(1 + n // 8))}
        x, y = hashes(own), hashes(other)
        sketches = [minhash._sketch(len(v), parity_bitmap(v)) for v in (x, y)]
        bound = may_link(*sketches, 85)
        assert may_link(*reversed(sketches), 85) == bound
        if 100 * len(own & other) >= 85 * len(own | other):
            assert bound is not None and bound <= len(own ^ other)


def test_forest_is_a_tree():
    bits, other = parity_bitmap(hashes(range(50))), parity_bitmap(hashes(range(100, 150)))
    links = block_forest([(f"n{i}", 50, bits if i < 6 else other, 3) for i in range(9)], 85)
    assert len(links) == 5 + 2 and {band for _, _, band in links} == {3}


@pytest.mark.parametrize("block", [256, 16])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STRAYS", block // 4)
    check(spark, corpus(random.Random(block)))


def test_partners_are_asked_for_until_none_is_left(spark, monkeypatch):
    """With the blocks' proposals taken away, the strays alone find every link."""
    monkeypatch.setattr(minhash._Search, "run", only_strays)
    check(spark, corpus(random.Random(5), copies=15))


def only_strays(self):
    most, more, linked = 1, True, True
    while linked or more:
        linked, more = self.propose_strays(most)
        most *= 4
    return self.roots


def test_odd_rows(spark):
    long = "word " * 5 + " ".join(f"t{i}" for i in range(20_000))
    check(spark, [(7, None), (5, ""), (5, ""), (6, " \n"), (None, ""), (9, "one two"), (8, "One  two"), (None, "one two three four"), (None, "one two"),
                  (3, long), (2, long + " tail"), (2, long), (4, "a a a a a a"), (1, "a a a")])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
