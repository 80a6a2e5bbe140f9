"""Registered queries of the corpus operators: SQL twins, and the pipeline by its stages."""

import pytest

import compare
import corpus_pipeline
from touchcredit.llm import decontam
from touchcredit.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare.spark_rows(QUERIES[name](spark, SF)) == compare.duck_rows(con, ORACLE[name])


def test_decontamination_hits_something(spark):
    assert QUERIES["op8_decontamination"](spark, SF).where("contaminated").count() > 0


def test_pipeline(spark):
    """Each stage on what the one before kept, then the whole."""
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == first.schema
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        kept[name] = len(rows)
        docs = spark.createDataFrame(rows, first.schema)
    assert first.count() == kept["language"] > kept["quality"] >= kept["near_duplicates"] >= kept["decontamination"] > 0
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contamination_digest(docs, benchmark).where("contaminated").count() == 0
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None, "a"), (1, "", "en", None, 0, "a"), (1, "", "en", None, 0, "a"), (2, "word " * 30_000, "en", "s", 5, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= (4 if name != "packing" else 100)
        if name != "packing":
            assert out.schema.names == docs.schema.names and {r.score for r in out.collect()} <= {"a", "b"}
