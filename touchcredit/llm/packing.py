"""Best-fit packing of tokenised documents by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence. The program covers every length's count by as few
configurations as possible. Multiplicative weights price the lengths: a length's price falls exponentially with what is
covered of it. A knapsack dynamic program finds the dearest configurations at these prices; near-optimal ones found in the
same table are used as well. Any prices give a bound that no packing can pass, the worth of all pieces over the dearest
configuration. The program is solved with slow prices first, which suits lengths that fill sequences exactly, and with
faster and faster ones while the result is over a hundredth above the bound. Each fractional solution is rounded down to
whole sequences, the program is solved again for what is left, and the rest is best-fitted into the room of the sequences
and into new ones. The plan with the fewest sequences is taken, and plain best fit, largest first, is among the plans. All
this sees lengths only, at most as many as a sequence has tokens, whatever the number of documents; the pieces then find
their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: How strongly the logarithm of a length's price follows what is missing of it, and in how many rounds a length can be
#: covered at the earliest: one after the other while the result is more than GAP above the bound.
RATES = ((0.005, 8), (1.0, 20), (4.0, 60), (16.0, 200))
GAP = 0.01
#: How often the program is solved for what rounding leaves.
PASSES = 3
#: A configuration is used if its price is this near to the best.
NEAR = 0.998
#: Pieces ranked in one group on average.
RANK_ROWS = 20_000
#: Chunks whose ids a worker remembers, twice over.
REMEMBERED = 250_000

Runs = tuple[tuple[int, int], ...]  # (length, how often), longest first


#: The tokenizer's byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
WORDS = regex.compile(public_tokenizers.PATTERN)
LATIN_END = "\u0250"
BEFORE_SPACE = re.compile(r"(?= \S)")


class ChunkIds(dict):
    """Ids of `lead` + chunk as little-endian bytes, remembered in two generations of bounded size."""

    def __init__(self, tokenizer, lead: str = ""):
        super().__init__()
        self.tokenize, self.lead, self.older = tokenizer.model.tokenize, lead, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            found = []
            # A run of Latin letters is one word by any splitting.
            plain = chunk.isalpha() and max(chunk) < LATIN_END
            for word in (self.lead + chunk,) if plain else WORDS.findall(self.lead + chunk):
                raw = word.encode("utf-8", "replace").decode("latin-1").translate(ALPHABET)
                found += [t.id for t in self.tokenize(raw)]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    """The ids of whole texts by the tokenizer's own splitting and model, chunk by chunk.

    The splitting never joins characters across a space that is followed by other than white space, nor across a
    single line end between two such characters. A special token's string in a text is that token, as the tokenizer has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.first, self.spaced = ChunkIds(tokenizer), ChunkIds(tokenizer, " ")
        self.special = {t.content: struct.pack("<I", i) for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit numbers, the separator last."""
        end = SEPARATOR.to_bytes(4, "little")
        if not text:
            return end
        if any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self.ids(part) for part in self.at_special.split(text)) + end
        return self.ids(text) + end

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        flat = text.replace("\n", " ")
        if not flat.isprintable() or "  " in flat or flat[0] == " " or flat[-1] == " ":
            return b"".join(map(self.first.__getitem__, BEFORE_SPACE.split(text)))
        out: list[bytes] = []
        for line in text.split("\n"):
            if out:
                out.append(self.first["\n"])
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += map(self.spaced.__getitem__, rest)
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    return Encoder(path)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every document's pieces of at most `capacity` tokens.

    Null and empty texts are the separator alone. A longer document is cut into full pieces, the first of which may be
    shorter. Only doc_id and text are read; null and repeated ids are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for at, value in enumerate(batch.column(1)):
                ids = encoded(value.as_py())
                total = len(ids) // 4
                ends = list(range(total % capacity or capacity, total, capacity)) + [total]
                first = 0
                for k, end in enumerate(ends):
                    part = ids[4 * first : 4 * end]
                    row.append(at)
                    piece.append(k)
                    start.append(first)
                    length.append(end - first)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                    first = end
            arrays = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return slim.mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest content of every capacity up to the given one; `lengths` ascend, each may be taken again."""
    if len(lengths) <= 256:  # one length after the other, all capacities at once
        best = np.zeros(capacity + 1)
        for x, price in zip(lengths.tolist(), prices.tolist(), strict=True):
            if price > 0 and x <= capacity:
                rows = -(-(capacity + 1) // x)
                often = np.arange(rows)[:, None] * price
                table = np.concatenate((best, np.zeros(rows * x - capacity - 1))).reshape(rows, x)
                best = (np.maximum.accumulate(table - often, axis=0) + often).ravel()[: capacity + 1]
        return np.maximum.accumulate(best)
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            best[c] = max(best[c], (prices[:n] + best[c - lengths[:n]]).max())
    return best


def fractional_configurations(
    counts: dict[int, int], capacity: int = CAPACITY, rate: float = RATES[0][0], rounds: int = RATES[0][1]
) -> tuple[dict[Runs, float], float]:
    """Configurations with the amounts that cover `counts`, by multiplicative weights, and the bound of their prices.

    In a round, configurations near the best are used until each of their lengths has got its share of the round, so a
    length that is dear in no configuration waits while its price rises against the others'. A configuration may leave as
    much room as the dearest one does: none where lengths fill a sequence exactly.
    """
    lengths = np.array(sorted(counts), np.int64)
    wanted = np.array([counts[x] for x in lengths], float)
    tokens = wanted * lengths
    covered = np.zeros(len(lengths))
    amounts: dict[Runs, float] = defaultdict(float)
    bound = 0.0
    for at in range(8 * rounds + 2 * len(lengths)):
        missing = np.maximum(0.0, 1.0 - covered / wanted)
        missing[missing < 1e-9] = 0.0
        if not missing.any():
            break
        # A length's weight falls with what is covered of it, against the average.
        prices = lengths / capacity * np.exp(rate * (missing - float((missing * tokens).sum() / tokens.sum())))
        prices[missing == 0] = 0.0
        best = knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ wanted) / best[capacity])
        slack = capacity - int(np.argmax(best >= best[capacity] * (1 - 1e-12)))
        # Towards the end the shares are what is left, so that every length is covered.
        share = wanted / rounds * 1.25 if at < 4 * rounds else wanted
        room = np.minimum(share, wanted - covered)
        before = covered.sum()
        value = prices + best[capacity - lengths]
        least = NEAR * best[capacity]
        for seed in np.argsort(-value, kind="stable"):
            while room[seed] > 1e-9 and value[seed] >= least:
                taken: dict[int, int] = {int(seed): 1}
                free = capacity - int(lengths[seed])
                while True:
                    n = bisect_left(lengths, free + 1)
                    if not n or best[free] <= 0:
                        break
                    worth = prices[:n] + best[free - lengths[:n]]
                    worth[room[:n] <= 1e-9] = -1.0
                    i = int(worth.argmax())
                    if worth[i] < NEAR * best[free] or worth[i] <= 0:
                        break
                    taken[i] = taken.get(i, 0) + 1
                    free -= int(lengths[i])
                if free > slack or sum(prices[i] * m for i, m in taken.items()) < least:
                    break  # too little room is left in this round for a near-optimal configuration with this length
                step = min(room[i] / m for i, m in taken.items())
                for i, m in taken.items():
                    room[i] -= step * m
                    covered[i] += step * m
                    if room[i] < 1e-9:
                        room[i] = 0.0
                key = tuple((int(lengths[i]), taken[i]) for i in sorted(taken, reverse=True))
                amounts[key] += step
        if at >= 4 * rounds and covered.sum() <= before:
            break
    return amounts, bound


class Sequences:
    """Sequences with equal contents as one row, and how many there are of each; open ones are found by their room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # by free space
        self.done: list[tuple[dict[int, int], int]] = []

    def put(self, runs: dict[int, int], times: int, free: int) -> None:
        if times:
            (self.open[free] if free else self.done).append((runs, times))

    def best_fit(self, counts: dict[int, int]) -> None:
        """Pieces, largest first, into the sequences with the least room that takes them, and into new ones."""
        for x in sorted(counts, reverse=True):
            rest = counts[x]
            for free in range(x, self.capacity):
                while rest and self.open.get(free):
                    runs, times = self.open[free].pop()
                    each = min(free // x, rest)
                    use = min(times, rest // each)
                    self.put(runs, times - use, free)
                    self.put({**runs, x: runs.get(x, 0) + each}, use, free - each * x)
                    rest -= use * each
                if not rest:
                    break
            each = self.capacity // x
            self.put({x: each}, rest // each, self.capacity - each * x)
            if rest % each:
                self.put({x: rest % each}, 1, self.capacity - rest % each * x)

    def plan(self) -> list[tuple[Runs, int]]:
        total: dict[Runs, int] = defaultdict(int)
        for runs, times in [*self.done, *(row for rows in self.open.values() for row in rows)]:
            total[tuple(sorted(runs.items(), reverse=True))] += times
        return sorted(total.items())


def rounded(counts: dict[int, int], capacity: int, rate: float, rounds: int) -> tuple[list[tuple[Runs, int]], float]:
    """The plan from the program at one rate, and the bound of its prices."""
    left, held, bound = dict(counts), Sequences(capacity), 0.0
    for at in range(PASSES):
        # Whole sequences of the fractional solution; the program is then solved again for what is left.
        amounts, own = fractional_configurations(left, capacity, rate, rounds)
        bound = own if not at else bound
        for runs, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
            times = min(int(amount + 1e-6), *(left.get(x, 0) // m for x, m in runs))
            if times > 0:
                for x, m in runs:
                    left[x] -= times * m
                held.put(dict(runs), times, capacity - sum(x * m for x, m in runs))
        left = {x: n for x, n in left.items() if n}
        if not left:
            break
    held.best_fit(left)
    return held.plan(), bound


def size(plan: list[tuple[Runs, int]]) -> int:
    return sum(times for _, times in plan)


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Runs, int]]:
    """Configurations and how many sequences have each; together they hold exactly `counts`."""
    wanted = {x: n for x, n in counts.items() if n > 0}
    if not wanted:
        return []
    bound = -(-sum(x * n for x, n in wanted.items()) // capacity)
    plans = []
    for rate, rounds in RATES:
        plan, own = rounded(wanted, capacity, rate, rounds)
        plans.append(plan)
        bound = max(bound, int(np.ceil(own - 1e-6)))
        if size(plan) <= bound * (1 + GAP):
            break
    plain = Sequences(capacity)
    plain.best_fit(wanted)
    # The program's plan counts first where both need as many.
    return min([*plans, plain.plan()], key=size)


def slot_table(plan: list[tuple[Runs, int]]) -> dict[int, np.ndarray]:
    """For each length its slots in order: (first rank, how often in a sequence, first sequence, offset) by configuration."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for runs, times in plan:
        offset = 0
        for x, m in runs:
            rows[x].append((ranks[x], m, sequence, offset))
            ranks[x] += m * times
            offset += m * x
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def ranked_by_length(pieces: DataFrame, total: int) -> DataFrame:
    """`pieces` with `rank`, gapless from 0 among those of equal length; a frequent length is ranked in many groups."""
    parts = max(1, -(-total // RANK_ROWS))
    order = ["doc_id", "piece", "ids_crc32"]
    own = pieces.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy("length", "__part").count()
    offsets = offsets.select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order))
    return (
        own.withColumn("__at", at - 1)
        .join(offsets, ["length", "__part"])
        .withColumn("rank", (F.col("__before") + F.col("__at")).cast("long"))
        .drop("__part", "__at", "__before")
    )


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length, ids_crc32 and whatever else) with sequence_id and offset; an empty table stays
    empty. Which of several pieces of equal length gets which place depends on their values alone."""
    counts = {int(x): int(n) for x, n in pieces.groupBy("length").count().collect()}
    plan = packed(counts, capacity)
    table = pieces.sparkSession.sparkContext.broadcast(slot_table(plan))
    ranked = ranked_by_length(pieces, sum(counts.values()))
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for x in np.unique(lengths):
                mine = np.flatnonzero(lengths == x)
                slots = table.value[int(x)]
                s = slots[np.searchsorted(slots[:, 0], ranks[mine], side="right") - 1]
                j = ranks[mine] - s[:, 0]
                sequence[mine] = s[:, 2] + j // s[:, 1]
                offset[mine] = s[:, 3] + j % s[:, 1] * x
            arrays = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    out = ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
    return out.select(*(c for c in pieces.columns), "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return placed(settled(pieces_of(docs, capacity, tokenizer)), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves."""
    pieces = placed(settled(pieces_of(docs, capacity, tokenizer, keep_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return pieces.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
