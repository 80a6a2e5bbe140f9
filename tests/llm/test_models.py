"""Language identification, quality and toxicity: held-out accuracy, and cases stated one by one."""

import random

import pytest
from pyspark.sql import functions as F

from touchcredit.llm import langid, quality, toxicity
from touchcredit.llm.common import held_out

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (1, None), (None, ""), (2, "123 !?"), (3, "½²"), (4, "x" * 50_000), (5, "日本語 の テキスト"), (6, "a\x00b퟿")]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "s", "p") for i, t in ODD], ODD_SCHEMA)


def test_held_out_is_the_checksum_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.sql("SELECT cast(null as bigint) AS id").select(held_out(F.col("id"))).first()[0] is True


def test_language_accuracy(documents):
    found = langid.language_predictions(documents)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() >= 0.98 * both.count()
    assert found.where("score < 0 OR score > 1 OR score IS NULL OR lang_pred IS NULL").count() == 0


def test_language_of_odd_texts(documents, odd):
    model = langid.fit(documents, 100)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()]
    assert [p for i, p in got if i in (1, 2, 3, None)] == ["und"] * 5
    assert all(p in model.languages for i, p in got if i in (4, 5, 6))
    # held-out rows and rows without a language teach nothing
    assert langid.fit(documents.where(held_out(F.col("doc_id")))).languages == []
    assert langid.fit(odd).languages == [] and langid.language_predictions(odd).where("lang_pred <> 'und'").count() == 0
    assert langid.language_predictions(documents.limit(0)).count() == 0


def test_unseen_words_fall_back_to_shorter_grams():
    model = langid.LanguageModel(grams={"<a": 0, "abc": 1, "b": 2, "c": 3, "d>": 4, "d": 5})
    assert model.segments("abcd") == [0, 2, 3, 4] and model.segments("xbxx") == [2] and model.segments("zz") == []


def test_quality_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(documents, labels)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == documents.count()
    both = found.join(labels, "doc_id").where("held_out")
    assert both.where("quality = predicted").count() >= 0.97 * both.count()
    assert found.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 as int)").count() == 0


def test_pairs_in_linear_time():
    """The score equals the sum over all pairs of features."""
    import numpy as np

    rng = np.random.default_rng(1)
    machine = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 7, 9, 2, 40]), rng.normal(size=5)
    logits, _, _ = machine.forward(index, value, np.array([0, 3]))
    for logit, own in zip(logits, ([0, 1, 2], [3, 4]), strict=True):
        want = 0.3 + sum(machine.weights[index[i]] * value[i] for i in own)
        want += sum(
            machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in own for j in own if i < j
        )
        assert logit == pytest.approx(want)


def test_scores_of_odd_texts(odd, labels):
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd, labels).collect()  # no labelled text: both models know nothing
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert scores(odd.limit(0), labels.limit(0)).count() == 0
        assert scores(odd.drop("n_chars"), labels).count() == len(ODD)


def test_labels_with_nulls_and_repeats(spark, documents, labels):
    more = labels.union(labels).union(spark.sql("SELECT cast(null as bigint), 1, 1")).union(
        labels.limit(5).select("doc_id", F.lit(None).cast("int"), F.lit(None).cast("int"))
    )
    repeated = documents.union(documents)
    found = quality.quality_scores(repeated, more)
    assert found.count() == 2 * documents.count()
    assert found.join(labels, "doc_id").where("quality = predicted").count() >= 0.95 * 2 * labels.count()


def test_toxicity_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity_scores(documents, labels)
    both = found.join(labels, "doc_id").where("held_out")
    assert both.where("toxic = predicted").count() >= 0.95 * both.count()


WORDS = ["stupid", "idiot", "moron", "worthless", "disgusting", "clown"]


@pytest.fixture(scope="module")
def restorer(spark, documents):
    extra = spark.createDataFrame([(" ".join(random.Random(i).choice(WORDS) for _ in range(50)),) for i in range(40)], "text string")
    return toxicity.Restorer(toxicity.corpus_model(documents.select("text").union(extra)).tolist())


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("$tupid", "stupid"), ("w0rthle$s", "worthless"),
        ("i-d-i-o-t", "idiot"), ("m.o.r.o.n", "moron"), ("d1sgu$ting", "disgusting"), ("st*pid", "stupid"), ("clown!!!", "clown"),
        ("mmmooorrrooonnn", "moron"), ("idiot", "idiot"), ("(idiot).", "idiot"), ("cl0wn,", "clown"),
    ],
)
def test_restored_words(restorer, token, word):
    assert word in restorer.words(token)


def test_spaced_words(restorer):
    _, spaced = toxicity.tokens_of("you are an i d i o t and a m 0 r 0 n !")
    assert [restorer.decode(s, True).split() for s in spaced[:1]] == [["idiot"]]
    assert "moron" in restorer.decode("m0r0n", True).split()


def test_plain_words_have_one_path(restorer):
    for word in ("the", "häuser", "réel", "ciónmente"):
        assert restorer.words(word) == [word] and restorer.decode(word) == word


def test_character_model_counts_everything(spark, documents):
    """Doubling the corpus leaves the probabilities nearly as they are, another corpus does not."""
    import numpy as np

    logs = toxicity.corpus_model(documents.select("text"))
    assert np.allclose(np.exp(logs).sum(axis=2), 1.0)
    assert np.abs(np.exp(toxicity.corpus_model(spark.createDataFrame([("zzz",), (None,), ("",)], "text string"))) - np.exp(logs)).max() > 0.1


@pytest.mark.parametrize(("token", "word"), [("stuupid", "stupid"), ("idiiot", "idiot"), ("iiddiioott", "idiot"), ("stuupid,", "stupid")])
def test_doubled_letters(restorer, token, word):
    assert word in restorer.words(token)
    assert "letter" in restorer.words("letter")


@pytest.mark.parametrize("text", ["i d i o t.", "(i d i o t)", "an \"i d i o t\", he said", "i, d, i, o, t!", "I D 1 O T?!"])
def test_punctuation_around_spaced_words(restorer, text):
    _, spaced = toxicity.tokens_of(text)
    assert [restorer.decode(s, True).split() for s in spaced] == [["idiot"]]


def all_paths(restorer, token, spaced):
    """(score, text) of every way through a token's lattice."""
    runs, at = [], 0
    while at < len(token):
        n = 1
        while at + n < len(token) and token[at + n] == token[at] and not spaced:
            n += 1
        runs.append((token[at], n))
        at += n
    paths = [(0.0, toxicity.BOUNDARY, toxicity.BOUNDARY, "")]
    for place, (c, n) in enumerate(runs):
        further = []
        for score, a, b, text in paths:
            for letters, cost in restorer.options(c, n):
                p, x, y = score + cost, a, b
                for letter in letters:
                    code = toxicity.CODES.get(letter, toxicity.OTHER if letter != " " else toxicity.BOUNDARY)
                    p, x, y = p + restorer.logs[x][y][code], y, code
                further.append((p, x, y, text + letters))
                if spaced and place + 1 < len(runs):
                    further.append((p + toxicity.BREAK + restorer.logs[x][y][toxicity.BOUNDARY], y, toxicity.BOUNDARY, text + letters + " "))
        paths = further
    return [(p + restorer.logs[a][b][toxicity.BOUNDARY], text) for p, a, b, text in paths]


@pytest.mark.parametrize("token", ["1d10t", "st*p1d", "m00r0n", "$tuup!", "a-b--c", "i11", "w0rr$e", "xx@@yy", "é3ß", "!!", "0"])
@pytest.mark.parametrize("spaced", [False, True])
def test_decoding_is_the_best_of_all_paths(restorer, token, spaced):
    paths = all_paths(restorer, token, spaced)
    text = restorer.decode(token, spaced)
    best = max(p for p, _ in paths)
    assert max(p for p, t in paths if t == text) == pytest.approx(best, abs=1e-9) and len(paths) >= 1


def test_very_long_tokens_take_time_by_their_length(restorer):
    import time

    rng = random.Random(8)
    token = "".join(rng.choice("abc1030$t") for _ in range(200_000))

    def seconds(n):
        start = time.process_time()
        assert restorer.decode(token[:n])
        return time.process_time() - start

    seconds(1000)
    assert seconds(200_000) < 14 * seconds(20_000) + 0.5
