import hashlib
import random

import pytest

from touchcredit.llm.decontam import contamination, contamination_digest, decontaminate, words_of

DOCS = "doc_id bigint, text string, hits string, lang string"


def plain(text):
    words, own = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if own:
                words.append(own)
            own = ""
        else:
            own += c
    return words + [own] * bool(own)


def plain_digest(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = plain(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    vocabulary = [f"wort{i}é" for i in range(40)] + ["The", "of", "日本語", "x1"]

    def text(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n"]) for _ in range(n))

    items = [(i, text(rng.randrange(12, 40))) for i in range(12)]
    items += [(12, "Only THREE words"), (13, ""), (14, None), (None, text(11)), (15, items[0][1]), (0, items[0][1]), (16, "...")]
    docs = [(i, text(rng.randrange(5, 200))) for i in range(30)]
    for i in range(30, 45):
        head, tail = text(20), text(15)
        docs.append((i, f"{head} {rng.choice([t for _, t in items if t]).upper()} {tail}"))
    docs += [(50, None), (51, ""), (None, items[3][1]), (52, "so only, three; words!"), (52, items[1][1]), (53, text(20_000) + items[2][1])]
    frame = spark.createDataFrame([(i, t, "own", "en") for i, t in docs], DOCS)
    return docs, items, frame, spark.createDataFrame(items, "item_id bigint, text string")


def test_words():
    for text in ("", None, "A-b_c 9é\x00Ü\x7fz", "\U0001f642 x", "a@b`c{d"):
        assert [w.decode() for w in words_of(text)] == plain(text)


@pytest.mark.parametrize("n", [10, 3, 1])
def test_equals_brute_force(tables, n):
    docs, items, frame, benchmark = tables
    got = contamination_digest(frame, benchmark, n).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_digest(docs, items, n)


def test_blocks_of_a_large_benchmark(tables):
    docs, items, frame, benchmark = tables
    whole = {(r.doc_id, r.text): r.hits for r in contamination(frame, benchmark).collect()}
    parts = {(r.doc_id, r.text): r.hits for r in contamination(frame, benchmark, block_bytes=700).collect()}
    assert whole == parts and any(h.words for h in whole.values())


def test_spans_or_documents_go(tables):
    docs, items, frame, benchmark = tables
    want = {(r[0], r[1]): r[5] for r in plain_digest(docs, items)}
    left = decontaminate(frame, benchmark, action="documents")
    assert left.columns == frame.columns and left.count() == sum(not x for x in [r[5] for r in plain_digest(docs, items)])
    assert {r.hits for r in left.collect()} == {"own"}
    cut = decontaminate(frame, benchmark)
    assert cut.columns == frame.columns and cut.count() == frame.count()
    again = contamination_digest(cut.where("doc_id >= 30 and doc_id < 45"), benchmark).where("contaminated").count()
    assert again <= 1  # a cut can bring words together
    before = {r.doc_id: r.text for r in frame.collect()}
    for r in cut.where("doc_id < 30 or doc_id in (50, 51)").collect():
        if not want[(r.doc_id, len(plain(before[r.doc_id])))]:
            assert r.text == before[r.doc_id]
    assert sorted(r.text for r in cut.where("doc_id = 52").collect()) == ["", "so !"]


def test_empty_tables(tables):
    _, _, frame, benchmark = tables
    assert contamination_digest(frame.limit(0), benchmark).count() == 0
    assert contamination_digest(frame, benchmark.limit(0)).where("contaminated").count() == 0
