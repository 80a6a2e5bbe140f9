"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is a linear part plus the inner products of the factors of every two of its features. With
s = sum of x_i v_i, these products are half of s * s minus the sum of (x_i v_i) * (x_i v_i): time in proportion to the
document's features.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import log2
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, settled, with_text_columns

BUCKETS = 1 << 15
BINS = 24
#: The machine is fitted on about this many labelled documents, chosen by a hash of the id.
SAMPLE_ROWS = 10_000
FACTORS = 8
#: Training makes so many passes over the sample, and more over a small one until it has made so many steps.
EPOCHS, STEPS = 6, 200
STEP_ROWS = 64
#: Rows that are scored at once.
BATCH = 256
THRESHOLD = 0.3
UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
MARKS = b"#$%&*+<=>@\\^_{|}~"
PIPES = b"|"
SHOUTS = b"!"
STOPS = b".,;:?"
FIELDS = 14


def share_bin(part: float, whole: float) -> int:
    """Small shares in finer bins."""
    return 0 if part <= 0 or whole <= 0 else min(BINS - 1, max(1, int(BINS + 2 * log2(min(1.0, part / whole)))))


def features(text: str | None, n_chars: int | None) -> tuple[list[int], list[float]]:
    """Indices and values: hashed words, whose squares sum to one, and one bin of each statistic.

    A null text is an empty one; n_chars, the only metadata, may be null.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = text.lower().split(), text.split("\n")
    distinct = set(words)

    def of(marks: bytes) -> int:
        return len(raw) - len(raw.translate(None, marks))

    statistics = [
        min(BINS - 1, int(2 * log2(len(words) + 1))),
        share_bin(len(distinct), len(words)),
        share_bin(sum(map(eq, words, words[1:])), len(words)),
        share_bin(of(UPPER), len(raw)),
        share_bin(of(DIGITS), len(raw)),
        share_bin(of(MARKS), len(raw)),
        share_bin(of(PIPES), len(raw)),
        share_bin(of(SHOUTS), len(raw)),
        share_bin(of(STOPS), len(raw)),
        share_bin(len(raw) - len(text), len(raw)),
        share_bin(len(lines) - len(set(lines)), len(lines)),
        min(BINS - 1, int(2 * log2(len(lines) + 1))),
        min(BINS - 1, len(text) // max(1, len(words))),
        0 if n_chars is None else min(BINS - 1, 1 + int(log2(max(0, n_chars) + 1))),
    ]
    hashed = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in distinct}
    each = 1.0 / max(1, len(hashed)) ** 0.5
    return (
        [BUCKETS + f * BINS + b for f, b in enumerate(statistics)] + sorted(hashed),
        [1.0] * FIELDS + [each] * len(hashed),
    )


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of rows whose features begin at `starts`."""
        logit, _, _ = self.forward(index, value, starts)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))

    def forward(self, index, value, starts):
        scaled = self.factors[index] * value[:, None]
        total = np.add.reduceat(scaled, starts)
        pairs = 0.5 * (total * total - np.add.reduceat(scaled * scaled, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + pairs, total, scaled


def train(rows: list[tuple[list[int], list[float], int]], seed: int = 5) -> FactorisationMachine:
    """Logistic loss by AdaGrad over shuffled batches. With one class, or none, the score is that class's rate."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + FIELDS * BINS
    labels = np.array([r[2] for r in rows], float)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    machine = FactorisationMachine(float(np.log(rate / (1 - rate))), np.zeros(size), np.zeros((size, FACTORS)))
    if len(set(labels)) < 2:
        return machine
    machine.factors = rng.normal(0.0, 0.05, (size, FACTORS))
    lengths = np.array([len(r[0]) for r in rows])
    indices, values = [np.asarray(r[0]) for r in rows], [np.asarray(r[1]) for r in rows]
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    epochs = max(EPOCHS, -(-STEPS // -(-len(rows) // STEP_ROWS)))
    for epoch in range(epochs):
        rate = 0.15 / (1 + 2.0 * epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP_ROWS):
            own = order[at : at + STEP_ROWS]
            index, value = np.concatenate([indices[i] for i in own]), np.concatenate([values[i] for i in own])
            starts = np.concatenate(([0], np.cumsum(lengths[own])[:-1]))
            logit, total, scaled = machine.forward(index, value, starts)
            wrong = 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))) - labels[own]
            each = np.repeat(wrong, lengths[own]) * value
            used, place = np.unique(index, return_inverse=True)
            step_w = np.bincount(place, each) / len(own) + 1e-6 * machine.weights[used]
            inner = each[:, None] * (np.repeat(total, lengths[own], axis=0) - scaled)
            step_v = np.stack([np.bincount(place, inner[:, k]) for k in range(FACTORS)], axis=1) / len(own)
            step_v += 1e-5 * machine.factors[used]
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            seen_b += wrong.mean() ** 2
            machine.weights[used] -= rate * step_w / np.sqrt(seen_w[used])
            machine.factors[used] -= 0.3 * rate * step_v / np.sqrt(seen_v[used])
            machine.bias -= rate * wrong.mean() / np.sqrt(seen_b)
    return machine


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Learns `label` from a bounded sample of labelled documents that are not held out. A repeated doc_id counts once."""
    known = labelled_sample(labels, label, rows)
    sample = with_n_chars(docs).select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")

    def make():
        def compute(texts, also):
            pairs = [features(t, n) for t, n in zip(texts, also["n_chars"], strict=True)]
            return [[p[0] for p in pairs], [p[1] for p in pairs]]

        return compute

    made = with_text_columns(sample, "index array<int>, value array<double>", make, ("n_chars",))
    made = settled(made.select("doc_id", "index", "value", "label").dropDuplicates(["doc_id"]))
    table = made.orderBy("doc_id").select("index", "value", "label").toArrow().combine_chunks()
    index, value = (table.column(c).combine_chunks() for c in ("index", "value"))
    starts = index.offsets.to_numpy()
    flat, amounts = index.values.to_numpy(), value.values.to_numpy()
    labels_of = table.column("label").to_pylist()
    spans = zip(starts[:-1].tolist(), starts[1:].tolist(), labels_of, strict=True)
    return train([(flat[a:b], amounts[a:b], y) for a, b, y in spans])


def rate(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= threshold), from the whole text and n_chars; `prefix` goes
    before the new names."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = shared.value

        def compute(texts, also):
            scores: list[float] = []
            for at in range(0, len(texts), BATCH):
                part = [features(t, n) for t, n in zip(texts[at : at + BATCH], also["n_chars"][at : at + BATCH], strict=True)]
                sizes = np.array([len(p[0]) for p in part])
                index = np.fromiter((i for p in part for i in p[0]), np.int64, int(sizes.sum()))
                value = np.fromiter((x for p in part for x in p[1]), float, int(sizes.sum()))
                scores += own.score(index, value, np.concatenate(([0], np.cumsum(sizes)[:-1]))).tolist()
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    return with_text_columns(with_n_chars(docs), f"{prefix}score double, {prefix}predicted int", make, ("n_chars",))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; empty texts are scored as well."""
    own = rate(with_n_chars(docs).select("doc_id", "text", "n_chars"), fit(docs, labels))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
