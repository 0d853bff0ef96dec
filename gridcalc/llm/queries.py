"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm import bpe_automaton, decontaminate, katz, multi_index, quality, simhash, token_counts, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    return Path(public_tokenizers.path(name)).read_text()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(spark, _table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(spark, _table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, _table(spark, sf_dir, "pages"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark, _table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 49407)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_multi_index": op6_multi_index,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_katz": op9_katz,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        r AS (SELECT *, payload_bytes >= 100 AND first <> page_id AS again FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
    """,
}
