"""Registered queries of the corpus operators; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import decontam, minhash, phrases, simhash, topk, warc
from .decontam import contamination_digest
from .langid import language_predictions
from .packing import pack
from .quality import quality_scores
from .sharding import shard_digest
from .topk import top_k_of_embeddings
from .toxicity import toxicity_scores
from .warc import archived_pages
from .whitening import whitened
from .wrappers import page_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_of_embeddings(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_html": op2_html,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op6_topk": topk.SQL,
    "op7_warc": warc.SQL,
    "op8_decontamination": decontam.SQL,
    "op11_minhash": minhash.SQL,
    "op13_phrases": phrases.SQL,
}
