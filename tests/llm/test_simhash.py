import random

import numpy as np
import pytest
import xxhash

from touchcredit.llm.simhash import (
    fingerprint,
    grid_cells,
    linked,
    near_duplicates,
    spanning_links,
    unary_code,
    without_near_duplicates,
)

DOCS = "doc_id bigint, text string, component_id string, fp int"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a b c", "A b\x0bc d e", "É é\xa0x y z w", "x " * 500, "a\x1cb c d e f"])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_lower_bound_and_grids_lose_nothing():
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 9)):
            b ^= 1 << bit
        pairs.append((a, b))
    a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*pairs, strict=True))
    hamming = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
    manhattan = np.bitwise_count(unary_code(a) ^ unary_code(b))
    counts = [[bin(int(x) >> s & 3).count("1") for s in range(0, 64, 2)] for x in a.view(np.uint64)]
    others = [[bin(int(x) >> s & 3).count("1") for s in range(0, 64, 2)] for x in b.view(np.uint64)]
    assert manhattan.tolist() == [sum(abs(x - y) for x, y in zip(p, q, strict=True)) for p, q in zip(counts, others, strict=True)]
    assert (manhattan <= hamming).all()
    met = np.any([x == y for x, y in zip(grid_cells(a, 4), grid_cells(b, 4), strict=True)], axis=0)
    assert met[hamming <= 4].all() and not met[manhattan > 16].any()


def cluster(rng, size, flips):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in set(rng.sample(range(64), flips))) for _ in range(size)]


def test_spanning_links_connect_a_dense_cluster_without_all_pairs():
    rng = random.Random(2)
    fps = sorted(set(cluster(rng, 400, 2) + [rng.getrandbits(64) for _ in range(50)]))
    links = spanning_links(np.array(fps, np.uint64).view(np.int64), 4)
    assert len(links) < len(fps)
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in links)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_components_equal_brute_force(spark, block, monkeypatch):
    import touchcredit.llm.simhash as simhash

    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda d, distance: links(d, distance, block))
    rng = random.Random(3)
    fps = cluster(rng, 150, 2) + [rng.getrandbits(64) for _ in range(60)]
    chain = rng.getrandbits(64)
    for i in range(0, 60, 4):  # a chain whose ends are far apart
        chain ^= 0xF << i
        fps.append(chain)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.fp: r.root for r in linked(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = plain_components(fps, 4)
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(x)
    assert {frozenset(v) for v in groups.values()} == {
        frozenset(k for k, r in got.items() if r == root) for root in set(got.values())
    }


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    long = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(3)]
    near = long[0].rsplit(" ", 1)[0]
    rows = [
        (5, long[0]), (3, near), (3, near), (9, long[1]), (None, long[1]), (7, ""), (8, None), (4, " \n"),
        (11, "same few words here"), (12, "Same FEW words here"), (None, long[2]), (6, long[0]), (6, "an other text with this id"),
    ]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def test_near_duplicates(spark, docs):
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, r.component_id) for r in rows), key=str)
    assert got == sorted(
        [(5, 3), (3, 3), (3, 3), (9, 9), (None, 9), (7, 4), (8, 4), (4, 4), (11, 11), (12, 11), (None, None), (6, 3), (6, 6)], key=str
    )
    texts = {r.doc_id: r.fingerprint for r in rows}
    assert texts[7] == "0" * 16 and all(len(f) == 16 for f in texts.values())


def test_one_of_each_group_stays(spark, docs):
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([3, 9, 4, 11, None, 6], key=str)


def test_empty(spark, docs):
    assert near_duplicates(docs.limit(0)).count() == 0 and without_near_duplicates(docs.limit(0)).count() == 0
