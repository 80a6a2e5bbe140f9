import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from touchcredit.llm import phrases
from touchcredit.llm.phrases import collocations, compact_paths, phrase_counts, words_of

DOCS = "text string, lang string, n int"


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def brute_counts(rows, longest=3):
    counts, totals = Counter(), Counter()
    for text, lang, _ in rows:
        for words in cut(text):
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def brute(rows, longest=3, least=10, covered=50, most=2000):
    counts, totals = brute_counts(rows, longest)
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = any(
            its == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (its, q), b in found.items()
        )
        if not inside:
            score, _, l, r = min(
                (10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]])
                for k in range(1, len(p))
            )
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, kept in out.items()
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most])
    )


def made(seed, n=60):
    """Random prose over few words, with repeated passages, copies and every kind of separator."""
    rng = random.Random(seed)
    words = ["a", "B", "c\xa0d", "é", "É", "x\x1cy", "the", "of"]
    passages = [" ".join(f"p{j}w{i}" for i in range(25)) for j in range(3)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randrange(0, 80)))
        if rng.random() < 0.5:
            text += " " + rng.choice(passages) + rng.choice(["", " the", ", of"])
        rows.append((text, rng.choice(["en", "fr", None]), 1))
    rows += [(None, "en", 1), ("", None, 1), (" \t. ", "fr", 1)] + [("same line of text over and over", "en", 1)] * 12
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_brute_force(spark, longest):
    rows = made(longest)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(tuple(r) for r in collocations(df, longest, least=4).collect())
    want = brute(rows, longest, least=4)
    assert got == want and len({r[0] for r in want}) == 3


def test_the_first_ones_of_each_lang(spark):
    rows = made(7)
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, DOCS), least=2, most=5).collect()) == brute(rows, least=2, most=5)


def test_counts_by_flow(spark, monkeypatch):
    """Also with crowded nodes, whose edges are dealt to parts."""
    rows = made(9)
    counts, totals = brute_counts(rows)
    want = {(k, " ".join(p)): a for (k, p), a in counts.items() if a >= 5} | {(k, ""): n for k, n in totals.items() if n}
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert {(r.lang, r.phrase): r.f for r in phrase_counts(df, least=5).collect()} == want
    short = phrases.short_words(["the", "é", "a"])
    crowded = {"en": [f"{short['the']} .of", f".of {short['the']}", f"{short['a']} {short['a']}"], "und": [f"{short['é']} {short['é']}"]}
    monkeypatch.setattr(phrases, "usual_words", lambda *_: (short, crowded))
    assert {(r.lang, r.phrase): r.f for r in phrase_counts(df, least=5).collect()} == want


def test_crowded_nodes(spark):
    df = spark.createDataFrame([("hot pair " + " ".join(f"u{i}x{j}" for j in range(9)), "en", i) for i in range(200)], DOCS)
    short, crowded = phrases.usual_words(df)
    assert f"{short['hot']} {short['pair']}" in crowded["en"]


def test_words_that_look_like_short_forms(spark):
    """Characters that stand for usual words, as words of the text."""
    short = [chr(c) for c in phrases.CHARACTERS[:40] if c not in (0x85, 0xA0)]
    rows = [(" ".join(short) + " usual usual usual word", "en", i) for i in range(6)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in collocations(df, least=2).collect()) == brute(rows, least=2)


def test_paths_are_maximal_and_of_one_count(spark):
    rows = [("start one two three four five end", "en", 1)] * 6 + [("other two three four five last", "en", 1)] * 5
    counts = phrase_counts(spark.createDataFrame(rows, DOCS), least=5)
    got = {(" ".join(r.path), r.f) for r in compact_paths(counts).collect()}
    assert got == {
        ("start one two three", 6), ("other two three", 5), ("two three four five", 11), ("four five end", 6), ("four five last", 5),
    }


def test_a_text_beyond_the_window(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcde") for _ in range(3000))
    counted = phrases._counted(pa.array(words_of(text), pa.binary()), 3, 3000, {})
    assert counted[2].sum() == 3000
    rows = [(text, "en", 1), (text[:1001], "en", 1)]
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, DOCS), longest=6, least=2, most=50).collect())
    assert got == brute(rows, longest=6, least=2, most=50)


def test_large_counts_are_exact(spark):
    counts = [("en", "a b", 2, 3 * 10**14), ("en", "a", 1, 7 * 10**14), ("en", "b", 1, 9 * 10**14 + 1), ("en", "", 0, 10**15)]
    df = spark.createDataFrame(counts, "lang string, phrase string, words int, f bigint")
    original, phrases.phrase_counts = phrases.phrase_counts, lambda *_: df
    try:
        (row,) = collocations(df).collect()
    finally:
        phrases.phrase_counts = original
    assert row.score == 10**6 * (3 * 10**14) ** 2 // (7 * 10**14 * (9 * 10**14 + 1))


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert collocations(df).count() == 0
    assert collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
