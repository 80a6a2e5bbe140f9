"""Language identification, word first: known words by their log frequency in each language, unseen words by the
longest character n-grams that are known, shorter and shorter ones where they are not."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settled, unit_hash, with_text_columns

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
#: The model is fitted on about this many training documents of each language, chosen by a hash of the id.
DOCS_PER_LANGUAGE = 2_000
#: Most frequent words and n-grams that the model keeps.
WORDS = 120_000
GRAMS = 100_000
LONGEST_GRAM = 5
#: Counted strings a task holds before it hands them on.
HELD = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def bounded_word(word: str) -> str:
    return f"<{word}>"


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def segments(self, word: str) -> list[int]:
        """The known n-grams that cover an unseen word from the left, the longest first; unknown characters tell nothing."""
        marked, found, at = bounded_word(word), [], 0
        get = self.grams.get
        while at < len(marked):
            for size in range(LONGEST_GRAM, 0, -1):
                known = get(marked[at : at + size])
                if known is not None:
                    found.append(known)
                    at += min(size, len(marked) - at)
                    break
            else:
                at += 1
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; `und` and 0 without letters or without a fitted language."""
        words = words_of(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        total = self.word_logs[ids[ids >= 0]].sum(axis=0, dtype=np.float64)
        grams = [g for i in np.flatnonzero(ids < 0).tolist() for g in self.segments(words[i])]
        if grams:
            total = total + self.gram_logs[grams].sum(axis=0, dtype=np.float64)
        chance = np.exp(total - total.max())
        best = int(chance.argmax())
        return self.languages[best], float(chance[best] / chance.sum())


def counted(rows: DataFrame, strings, schema: str) -> DataFrame:
    """(lang, token, n) summed over `rows`; `strings` turns a batch into (lang, Counter) pairs. Tasks sum what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            flat = [(lang, token, n) for lang, own in held.items() for token, n in own.items()]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            kinds = (pa.string(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "token", "n"])

        for batch in batches:
            for lang, own in strings(batch):
                held.setdefault(lang, Counter()).update(own)
            if sum(map(len, held.values())) > HELD:
                yield out()
                held.clear()
        yield out()

    return rows.mapInArrow(run, schema).groupBy("lang", "token").agg(F.sum("n").alias("n"))


def logs(table: DataFrame, keep: int, languages: list[str], totals: dict[tuple[str, int], int], order) -> tuple[dict[str, int], np.ndarray]:
    """The `keep` most frequent tokens with their smoothed log frequencies in each language."""
    counts = [F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{j}") for j, lang in enumerate(languages)]
    rows = (
        table.groupBy("token").agg(F.sum("n").alias("total"), *counts)
        .orderBy(F.col("total").desc(), "token").limit(keep).drop("total").toArrow()
    )
    index = {token: i for i, token in enumerate(rows.column("token").to_pylist())}
    orders = [order(token) for token in index]
    out = np.zeros((len(index), len(languages)), np.float32)
    for j, lang in enumerate(languages):
        seen = rows.column(f"n{j}").fill_null(0).to_numpy().astype(float)
        size = np.array([totals.get((lang, o), 0) for o in orders], float)
        out[:, j] = np.log((seen + 0.5) / (size + 0.5 * max(1, len(index))))
    return index, out


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Learns from text and non-null lang of documents that are not held out, from a bounded sample for each language.

    Null texts and texts without letters teach nothing. Without training rows the model knows no language.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel()
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, docs_per_language / n))))
    sample = own.where(unit_hash(F.col("doc_id"), seed=3) < F.element_at(rates, F.col("lang"))).where("text IS NOT NULL")

    def batch_words(batch):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield lang, words_of(text)

    def batch_grams(batch):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marked = bounded_word(word)
            grams: Counter = Counter()
            for size in range(1, LONGEST_GRAM + 1):
                for i in range(len(marked) - size + 1):
                    grams[marked[i : i + size]] += n
            yield lang, grams

    schema = "lang string, token string, n bigint"
    known = settled(counted(sample.select("lang", "text"), batch_words, schema))
    pieces = settled(counted(known, batch_grams, schema))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return LanguageModel()
    word_totals = {(r["lang"], 0): r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by_order = pieces.groupBy("lang", F.length("token").alias("size")).agg(F.sum("n").alias("n"))
    gram_totals = {(r["lang"], r["size"]): r["n"] for r in by_order.collect()}
    word_index, word_logs = logs(known, words, languages, word_totals, lambda _: 0)
    gram_index, gram_logs = logs(pieces, grams, languages, gram_totals, len)
    return LanguageModel(languages, word_index, word_logs, gram_index, gram_logs)


def identify(docs: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1), from the whole text alone; `prefix` goes before the new names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def compute(texts, _):
            pairs = [found.predict(t) for t in texts]
            return [[p[0] for p in pairs], [p[1] for p in pairs]]

        return compute

    return with_text_columns(docs, f"{prefix}lang_pred string, {prefix}score double", make)


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; empty tables give empty results."""
    own = identify(docs.select("doc_id", "text"), fit(docs))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
