"""Phrase collocations from a weighted de Bruijn graph.

Texts are cut into pieces and words. Every word begins one longest gram: of `longest` words, or of those that are left of its
piece. Full grams are the edges of the graph, from their first words (a node) to their last ones; shorter grams are piece
ends. Edges and piece ends are counted, and nothing else is: a node's count is the flow out of it plus the pieces that end in
it, and counts of still shorter phrases follow from those in the same way, down to the number of all words.

Of the counted graph, edges and nodes of a least count are kept. A node is passed straight through if one edge brings all its
count and one takes it all; chains of edges over such nodes are compacted to paths of one count by pointer doubling. Inside
a path every phrase of a node's length has the path's count and is contained in its edges; other counts are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, unit_hash

#: Fixed values of the query: where pieces end (words end at the space and the tab).
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"
#: No byte of UTF-8 text; stands between pieces.
CUT = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz" + CUT * len(PIECE_ENDS))
#: Documents of the sample that shows the usual words and which nodes are crowded, the share of all grams that makes a node
#: so, and the number of parts that its edges are dealt to. Only the size and the place of rows depends on these.
SAMPLE, CROWDED, PARTS = 4_000, 1 / 50_000, 64
#: A usual word is moved as one character of two or three bytes; there are so many of them.
CHARACTERS = [*range(0x80, 0xD800), *range(0xE000, 0x10000)]
#: Begins words that are moved as they are; no word has it, because pieces end there.
PLAIN = "."


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, with a CUT at the end of every piece."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).replace(CUT, b" \xff ").split()


def short_words(usual: list[str]) -> dict[str, str]:
    """Usual words, the most frequent first, with the character that each is moved as."""
    return {w: chr(c) for w, c in zip(usual, CHARACTERS, strict=False)}


def spelled_out(counts: DataFrame, short: dict[str, str]) -> DataFrame:
    """Phrases with their words in full again."""
    words = {c: w for w, c in short.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("phrase")
            full = [" ".join(words.get(w) or w[1:] for w in p.split(" ")) if p else p for p in batch.column(place).to_pylist()]
            yield batch.set_column(place, "phrase", pa.array(full, pa.string()))

    return counts.mapInArrow(run, counts.schema)


def _counted(words: pa.Array, longest: int, starts: int, short: dict[str, str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The node, the word after it and the count of the longest grams that begin at the first `starts` words."""
    coded = pa.concat_arrays([words, pa.array([CUT], pa.binary())]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    full = [b"" if w == CUT else w for w in coded.dictionary.to_pylist()]
    known = pa.array([short.get(w) or PLAIN + w for w in map(bytes.decode, full)], pa.string())
    base, cut = len(known), int(codes[-1])
    # Past the end of its piece a gram has only CUTs.
    key, within = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for i in range(longest):
        at = np.concatenate((codes[i:], np.full(i, cut)))
        within &= at != cut
        key = key * base + np.where(within, at, cut)
    key, counts = np.unique(key[:starts][codes[:starts] != cut], return_counts=True)
    places = []
    for _ in range(longest):
        key, place = np.divmod(key, base)
        places.append(known.take(pa.array(place, mask=place == cut)))
    after, *node = places
    return pc.binary_join_element_wise(*reversed(node), " ", null_handling="skip"), after, counts


def longest_grams(
    docs: DataFrame, longest: int = 3, short: dict[str, str] | None = None, crowded: dict[str, list[str]] | None = None
) -> DataFrame:
    """(place, after, f): counts of the longest gram that begins at each word, as the place of its first words and the last.

    A place is the node, a part and the lang, with tabs between them, in one string, because rows are many and every
    column costs. `after` is null where the piece ends with the node. Words are moved by the `short` ones or behind PLAIN.
    Counts are those of up to a million words each and still to be added up. Edges of the `crowded` nodes of a lang are
    dealt to parts by their last word; others have an empty part.
    """
    short = short or {}
    if not 2 <= longest <= 8:
        raise ValueError("phrases have 2 to 8 words")
    window = min(1 << 20, int(2 ** (62 / longest)) - 2)

    def emit(lang: str, words: pa.Array, starts: int) -> pa.RecordBatch:
        node, after, counts = _counted(words, longest, starts, short)
        place = pc.binary_join_element_wise(node, "\t" + lang, "\t")
        if crowded and lang in crowded:
            full = pc.is_in(node, pa.array(crowded[lang], pa.string()))
            parts = [f"{n}\t{sum((w or '').encode()) % PARTS}\t{lang}" for n, w in zip(node.filter(full).to_pylist(), after.filter(full).to_pylist(), strict=True)]
            place = pc.replace_with_mask(place, full, pa.array(parts, pa.string()))
        return pa.RecordBatch.from_arrays([place, after, pa.array(counts, pa.int64())], names=["place", "after", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        total = 0

        def all_held() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                words = pa.concat_arrays(parts)
                yield emit(lang, words, len(words))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = pa.array([*words_of(text.as_py()), CUT], pa.binary())
                # A text beyond the window is counted in parts that see the words after them.
                while len(words) > window:
                    yield emit(lang, words[:window], window - longest + 1)
                    words = words[window - longest + 1 :]
                if total + len(words) > window:
                    yield from all_held()
                    held, total = {}, 0
                held.setdefault(lang, []).append(words)
                total += len(words)
        yield from all_held()

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    return texts.mapInArrow(run, "place string, after string, f bigint")


def _at_place(i: int) -> Column:
    return F.split("place", "\t", 3)[i]


def usual_words(docs: DataFrame, longest: int = 3) -> tuple[dict[str, str], dict[str, list[str]]]:
    """From about SAMPLE documents: short forms of the most frequent words, and the nodes, in these forms, with more than a
    share of CROWDED of all grams. There are at most as many as characters and 1 / CROWDED of them."""
    rows = docs.count()
    sample = longest_grams(docs.where(unit_hash(F.col("text"), seed=13) < SAMPLE / max(rows, 1)), longest)
    nodes = sample.groupBy("place").agg(F.sum("f").alias("f"))
    grams = settled(nodes.select(_at_place(0).alias("node"), _at_place(2).alias("lang"), "f"))
    words = grams.groupBy(F.substring(F.substring_index("node", " ", 1), 2, 1 << 30).alias("word")).agg(F.sum("f").alias("f"))
    short = short_words([r.word for r in words.orderBy(F.desc("f"), "word").limit(len(CHARACTERS)).collect()])
    least = CROWDED * (grams.agg(F.sum("f")).first()[0] or 0)
    crowded: dict[str, list[str]] = {}
    for lang, node in grams.where(F.col("f") > max(least, 8)).select("lang", "node").collect():
        crowded.setdefault(lang, []).append(" ".join(short.get(w[1:], w) for w in node.split(" ")))
    return short, crowded


def number_of_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to `longest` words that occur at least `least` times, and the number of
    all words of each lang as the phrase of 0 words. Words are joined by one space."""
    short, crowded = usual_words(docs, longest)
    dealt = longest_grams(docs, longest, short, crowded).repartition("place")
    edges = dealt.groupBy("place", "after").agg(F.sum("f").alias("f"))
    out = F.struct(F.lit(None).cast("string").alias("after"), F.lit(False).alias("edge"), "f")
    frequent = F.col("after").isNotNull() & (F.col("f") >= least)
    made = F.when(frequent, F.array(out, F.struct("after", F.lit(True).alias("edge"), "f"))).otherwise(F.array(out))
    # Where the edges are, their nodes' flows and ends are added up: no shuffle but that of the edges.
    graph = edges.select("place", F.inline(made)).groupBy("place", "edge", "after").agg(F.sum("f").alias("f"))
    node = _at_place(0)
    rows = graph.select(
        _at_place(2).alias("lang"),
        F.concat_ws(" ", node, "after").alias("phrase"),
        F.when(F.col("edge"), F.lit(longest)).otherwise(number_of_words(node)).alias("words"),
        "f",
        (_at_place(1) != "").alias("partial"),
    )
    for k in range(longest - 1, 0, -1):
        shorter = F.substring_index("phrase", " ", k - 1) if k > 1 else F.lit("")
        shorter = F.struct(shorter.alias("phrase"), F.lit(k - 1).alias("words"), "f")
        own = F.struct("phrase", "words", "f")
        passed = F.when((F.col("f") >= least) | F.col("partial"), F.array(own, shorter)).otherwise(F.array(shorter))
        made = F.when(F.col("words") == k, passed).otherwise(F.array(own))
        rows = rows.select("lang", F.inline(made)).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        rows = rows.withColumn("partial", F.lit(False))
    return spelled_out(rows.where((F.col("words") == 0) | (F.col("f") >= least)).drop("partial"), short)


def compact_paths(counts: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, path, f): chains of the counted edges over nodes that are passed straight through, as arrays of words.

    A path lies within one piece wherever it occurs, so its length is bounded by the longest piece.
    """
    node = counts.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), F.col("f").alias("all"))
    edges = counts.where(F.col("words") == longest).select("lang", F.col("phrase").alias("edge"), "f")
    tails = edges.withColumn("node", F.substring_index("edge", " ", longest - 1)).join(node, ["lang", "node"])
    heads = edges.withColumn("node", F.substring_index("edge", " ", -(longest - 1))).join(node, ["lang", "node"])
    takes_all = tails.where(F.col("f") == F.col("all")).select("lang", "node", F.col("edge"))
    brings_all = heads.where(F.col("f") == F.col("all")).select("lang", "node", F.col("edge").alias("before"))
    before = takes_all.join(brings_all, ["lang", "node"]).select("lang", "edge", "before")
    links = settled(
        edges.join(before, ["lang", "edge"], "left")
        .select("lang", "edge", "f", F.coalesce("before", "edge").alias("first"), F.col("before").isNotNull().cast("int").alias("steps"))
        .withColumn("done", F.col("steps") == 0)
    )
    while not links.where(~F.col("done")).isEmpty():
        to = links.select("lang", F.col("edge").alias("first"), F.col("first").alias("far"), F.col("steps").alias("more"), F.col("done").alias("there"))
        jumped = links.where(~F.col("done")).join(to, ["lang", "first"]).select(
            "lang", "edge", "f", F.col("far").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done")
        )
        links = settled(links.where("done").unionByName(jumped))
    ends = F.collect_list(F.struct("steps", F.substring_index("edge", " ", -1).alias("word")))
    words = F.concat(F.slice(F.split("first", " "), 1, longest - 1), F.transform(F.array_sort("ends"), lambda x: x["word"]))
    # A path's first edge has step 0, or the step 1 of an edge that points to it: heads point to themselves with 0 steps.
    return links.groupBy("lang", "first").agg(F.max("f").alias("f"), ends.alias("ends")).select("lang", words.alias("path"), "f")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, most: int = 2000) -> DataFrame:
    """The `most` best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to `longest` words with a = f(phrase) >= `least`; a cut after the first words gives l and r,
    the counts of both sides, and the score floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, of equal ones
    the first. A candidate inside a longer one of at least `covered` per cent of its count is dropped. Ranked by score, then
    a, both descending, then by the phrase's bytes. A null text has no words, a null lang counts as `und`; repeated rows
    count as often as they occur; an empty table gives an empty result. Other columns are not read. Counts up to 10 ** 15
    are exact.
    """
    counts = settled(phrase_counts(docs, longest, least))
    paths = settled(compact_paths(counts, longest))
    edge = F.posexplode(F.sequence(F.lit(0), F.size("path") - longest)).alias("_", "i")
    on_paths = paths.select("lang", "path", "f", edge).select(
        "lang",
        F.slice("path", F.col("i") + 1, longest).alias("w"),
        F.col("f").alias("a"),
        F.when(F.col("i") > 0, F.col("f")).alias("first"),
        F.when(F.col("i") < F.size("path") - longest, F.col("f")).alias("last"),
    )
    # Nodes inside a path are no candidates: the path's edges contain them with the same count.
    inside = on_paths.where("first is not null").select("lang", F.array_join(F.slice("w", 1, longest - 1), " ").alias("phrase"))
    short = counts.where(F.col("words").between(2, longest - 1)).join(inside, ["lang", "phrase"], "left_anti")
    unknown = F.lit(None).cast("bigint")
    candidates = on_paths.union(short.select("lang", F.split("phrase", " "), F.col("f"), unknown, unknown))
    candidates = candidates.withColumn("phrase", F.array_join("w", " "))

    words = F.size("w")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(2), words - 1),
            lambda n: F.transform(F.sequence(F.lit(1), words - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")),
        )
    )
    within = candidates.where(words > 2).select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))

    cuts = kept.select(
        "lang", "phrase", "a", "first", "last", F.col("w"), F.explode(F.sequence(F.lit(1), words - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, words), " ").alias("right"),
        F.when(F.col("k") == longest - 1, F.col("first")).alias("l"),
        F.when((F.col("k") == 1) & (words == longest), F.col("last")).alias("r"),
    )

    def looked_up(rows: DataFrame, side: str, count: str) -> DataFrame:
        known = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        found = rows.where(F.col(count).isNull()).drop(count).join(known, ["lang", side])
        return rows.where(F.col(count).isNotNull()).unionByName(found)

    scored = looked_up(looked_up(cuts, "left", "l"), "right", "r").withColumn(
        "score",
        F.expr(
            "(1000000BD * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"
        ),
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB SQL, counting phrases of every length.
SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, w[i] AS p1, w[i + 1] AS p2, w[i + 2] AS p3
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)
),
counts AS (
    SELECT lang, p1 AS phrase, 1 AS size, count(*) AS f FROM grams GROUP BY ALL
    UNION ALL SELECT lang, p1 || ' ' || p2, 2, count(*) FROM grams WHERE p2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, p1 || ' ' || p2 || ' ' || p3, 3, count(*) FROM grams WHERE p2 IS NOT NULL AND p3 IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10),
longer AS (
    SELECT lang, phrase, max(a) AS most
    FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3)
    GROUP BY lang, phrase
),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE size = 3 OR most IS NULL OR 100 * most < 50 * a
),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
),
scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = rest
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
