"""Toxicity by noisy-channel deobfuscation: what a token may have been before letters were swapped for look-alikes,
spaced out or repeated is a character lattice; Viterbi finds its likeliest path under a character language model of the
corpus, and the restored words are scored.

A token of plain letters without repetition has a single path, itself, so only other tokens are decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, settled, unit_hash, with_text_columns

#: Fixed values of the channel: letters that a look-alike may stand for, the most usual first.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = "-_.,*~'’`·:;/\\"
#: Letters the language model tells apart; all others are one class, and what is no letter is the boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
BOUNDARY, OTHER, CLASSES = 0, len(LETTERS) + 1, 64
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}

#: Log costs of the channel's edits.
SWAP, WILD, DROP, SQUEEZE, BREAK = -0.7, -1.5, -0.3, -0.7, -1.0
BEAM = 48

SAMPLE_ROWS = 16_000
THRESHOLD = 0.5
#: Features the classifier keeps, and how long prefixes are that count as features beside whole words.
FEATURES = 100_000
PREFIXES = (4, 5, 6, 7)
LEAST_POSITIVE = 3
REMEMBERED = 400_000
REPEATED = re.compile(r"(.)\1")
#: Punctuation around a token that is no part of it.
AROUND = "\"'()[]{}<>.,;:?!…«»“”„"


def code_table() -> np.ndarray:
    """Class of every code point below 0x250; letters above are OTHER."""
    table = np.full(0x250, OTHER, np.uint8)
    for point in range(0x250):
        c = chr(point).lower()
        table[point] = CODES.get(c, OTHER if c.isalpha() else BOUNDARY)
    return table


def corpus_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a character class after two others, counted over all texts and smoothed by shorter contexts.

    Each task counts into one array and hands on a row for each context it met. Null and empty texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = code_table(), np.zeros(CLASSES**3, np.int64)

        def count(text: str) -> None:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            codes = np.where(points < 0x250, table[np.minimum(points, 0x24F)], OTHER).astype(np.int32)
            if len(codes) > 2:
                seen[:] += np.bincount((codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:], minlength=CLASSES**3)

        for batch in batches:
            held, size = [], 0
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    held.append(text)
                    size += len(text)
                if size > 1 << 20:
                    count("  " + "  ".join(held) + "  ")
                    held, size = [], 0
            if held:
                count("  " + "  ".join(held) + "  ")
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(seen[met])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    three = np.zeros(CLASSES**3)
    for gram, n in rows:
        three[gram] = n
    three = three.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1.0) / (one.sum() + CLASSES)
    p2 = (two + 5.0 * p1) / (two.sum(axis=1, keepdims=True) + 5.0)
    p3 = (three + 5.0 * p2) / (three.sum(axis=2, keepdims=True) + 5.0)
    return np.log(p3)


@dataclass
class Restorer:
    """Viterbi over a token's lattice. `logs` is the corpus model as nested lists."""

    logs: list

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest text behind a lower-case token; `spaced`: single characters with spaces taken out between them."""
        # A state knows its last letters and the state before it, so a long token's text is put together once.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BOUNDARY, BOUNDARY): (0.0, None)}
        at = 0
        while at < len(token):
            c, n = token[at], 1
            while at + n < len(token) and token[at + n] == c and not spaced:
                n += 1
            at += n
            states = self.step(states, self.options(c, n), spaced and at < len(token))
        logs = self.logs
        _, _, last = max((score + logs[a][b][BOUNDARY], (a, b), last) for (a, b), (score, last) in states.items())
        letters: list[str] = []
        while last is not None:
            last, own = last
            letters.append(own)
        return "".join(reversed(letters))

    @staticmethod
    def options(c: str, n: int) -> list[tuple[str, float]]:
        """What `n` equal characters may stand for."""
        if c.isalpha():
            return [(c, 0.0 if n == 1 else SQUEEZE)] + ([(c * 2, 0.0 if n == 2 else SQUEEZE)] if n > 1 else [])
        found = [("", DROP)] if c in SEPARATORS else []
        letters = LOOKALIKES.get(c, "")
        cost = WILD if len(letters) > 2 else SWAP
        for x in letters:
            found.append((x, cost if n == 1 else cost + SQUEEZE))
            if n > 1:
                found.append((x * 2, cost if n == 2 else cost + SQUEEZE))
        return found or [(" ", 0.0)]

    def step(self, states, options, may_break: bool):
        logs, after = self.logs, {}
        for (a, b), (score, last) in states.items():
            for letters, cost in options:
                p, x, y = score + cost, a, b
                for letter in letters:
                    code = CODES.get(letter, OTHER if letter != " " else BOUNDARY)
                    p, x, y = p + logs[x][y][code], y, code
                ways = [(p, x, y, letters)]
                if may_break:
                    ways.append((p + BREAK + logs[x][y][BOUNDARY], y, BOUNDARY, letters + " "))
                for p, x, y, own in ways:
                    if (x, y) not in after or p > after[x, y][0]:
                        after[x, y] = (p, (last, own))
        if len(after) > BEAM:
            after = dict(sorted(after.items(), key=lambda s: -s[1][0])[:BEAM])
        return after

    def words(self, token: str) -> list[str]:
        """The words of a lower-case token: its plain runs of letters, and what it restores to."""
        bare = token.strip("\"'()[]{}<>.,;:?!…«»“”„-_*#%&~^=/\\|")
        if bare.isalpha() and not REPEATED.search(bare):
            tail = token[token.find(bare) + len(bare) :] if bare else ""
            head = token[: token.find(bare)] if bare else ""
            if not (set(head + tail) & set("!|") and (head or len(tail) == 1 and tail == "|")):
                return [bare]
        found = [w for w in re.split(r"[\W\d_]+", token) if w]
        for own in {bare, token}:
            if any(c.isalpha() for c in own) or sum(c in LOOKALIKES for c in own) > 3:
                found += self.decode(own).split()
        return list(dict.fromkeys(found))


def tokens_of(text: str | None) -> tuple[set[str], list[str]]:
    """Distinct lower-case tokens, and runs of at least three single characters with the spaces and the punctuation around
    them taken out."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return set(), []
    bare = [t if len(t) == 1 else t.strip(AROUND) for t in tokens]
    single = np.fromiter(map(len, bare), np.int64, len(bare)) == 1
    if single.sum() < 3:
        return set(tokens), []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    return set(tokens), ["".join(bare[a:b]) for a, b in edge.reshape(-1, 2).tolist() if b - a >= 3]


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


class Evidence(dict):
    """The strongest evidence for a toxic document that each token carries; remembered in bounded number."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def of(self, words: list[str]) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in words for f in word_features(w)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.of(self.restorer.words(token))
        if len(token) < 64:
            self[token] = value
        return value

    def strongest(self, text: str | None) -> tuple[float, float]:
        """The two greatest values among the distinct tokens and spaced-out runs of a whole text."""
        tokens, spaced = tokens_of(text)
        first = second = 0.0
        values = [*map(self.__getitem__, tokens), *(self.of(self.restorer.decode(s, True).split()) for s in set(spaced))]
        for v in values:
            if v > second:
                first, second = (v, first) if v > first else (first, v)
        return first, second


@dataclass
class ToxicityModel:
    logs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def evidence(self) -> Evidence:
        return Evidence(Restorer(self.logs.tolist()), self.weights)

    def probability(self, first: float, second: float) -> float:
        logit = self.bias + self.slopes[0] * first + self.slopes[1] * second
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, logit))))


def feature_weights(sample: DataFrame, logs: np.ndarray) -> dict[str, float]:
    """Log odds of the features that speak for label 1 in `sample` (text, label), each shrunk by its own uncertainty."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for x, n in sizes.items() if x != 1)
    if not toxic or not clean:
        return {}
    shared = sample.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.tolist())
        every: Counter = Counter()
        known: dict[str, list[str]] = {}
        positive: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = list(every)
            counts = [pa.array([c[f] for f in names], pa.int64()) for c in (every, positive)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["feature", "n", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, spaced = tokens_of(text)
                found = set()
                for t in tokens:
                    if t not in known:
                        known[t] = [f for w in restorer.words(t) for f in word_features(w)]
                    found.update(known[t])
                for s in spaced:
                    found.update(f for w in restorer.decode(s, True).split() for f in word_features(w))
                every.update(found)
                if label == 1:
                    positive.update(found)
                if len(every) > REMEMBERED:
                    yield out()
                    every.clear()
                    positive.clear()
                if len(known) > REMEMBERED:
                    known.clear()
        yield out()

    n, hits = F.col("n"), F.col("toxic")
    sure = F.greatest(hits - 1.5 * F.sqrt(hits), F.lit(0.0)) + 0.5
    against = n - hits + F.sqrt(n - hits) + 0.5
    weight = F.log(sure / float(toxic + 1)) - F.log(against / float(clean + 1))
    rows = (
        sample.select("text", "label").mapInArrow(run, "feature string, n bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where(hits >= LEAST_POSITIVE).select("feature", weight.alias("weight")).where("weight > 0.5")
        .orderBy(F.col("weight").desc(), "feature").limit(FEATURES).collect()
    )
    return {r["feature"]: r["weight"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """The language model from all texts; the classifier from a bounded sample of labelled documents not held out.

    Features are weighed on half of the sample, a logistic curve is fitted to the evidence they give for the other half,
    and the features are weighed again on all of it. Without both labels every score is 0.
    """
    logs = corpus_model(docs)
    model = ToxicityModel(logs, bias=-40.0)
    known = labelled_sample(labels, label, rows)
    sample = settled(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]))
    half = unit_hash(F.col("doc_id"), seed=23) < 0.5
    trial = ToxicityModel(logs, feature_weights(sample.where(half), logs))
    scored = with_evidence(sample.where(~half).select("doc_id", "text", "label"), trial).select("first", "second", "label")
    curve = np.array([tuple(r) for r in scored.toLocalIterator()], float).reshape(-1, 3)
    model.weights = feature_weights(sample, logs)
    if len(curve) and model.weights and 0 < curve[:, 2].sum() < len(curve):
        x = np.column_stack((np.ones(len(curve)), curve[:, :2]))
        beta = np.zeros(3)
        for _ in range(30):  # Newton steps of a ridge regression
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            pull = np.array([1e-3, 0.05, 0.05])
            beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - curve[:, 2]) + pull * beta)
        model.bias, model.slopes = float(beta[0]), (float(beta[1]), float(beta[2]))
    return model


def with_evidence(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value.evidence()

        def compute(texts, _):
            pairs = [own.strongest(t) for t in texts]
            return [[p[0] for p in pairs], [p[1] for p in pairs]]

        return compute

    return with_text_columns(docs, "first double, second double", make)


def assess(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= threshold), from the whole text alone.

    Null and empty texts carry no evidence; their score is the least.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        own = model.evidence()

        def compute(texts, _):
            scores = [model.probability(*own.strongest(t)) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    return with_text_columns(docs, "score double, predicted int", make)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = assess(docs.select("doc_id", "text"), fit(docs, labels))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
