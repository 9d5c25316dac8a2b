"""The ``opN_<name>`` queries over the shared tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, html_extraction, language, minhash, packing, sharding, suffix_dedup, tool_calls, url_filter
from .oracles import ORACLE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents")).drop("removed")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_tool_calls(_read(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_read(spark, sf_dir, "documents"), minhash.NearRule(words=3, percent=85, rows=5))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_edits(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judged = language.identify(docs, language.learn(docs, ~language.held_out()), ["doc_id"])
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


__all__ = ["ORACLE", "QUERIES"]
QUERIES = {q.__name__: q for q in (op1_url_filter, op2_suffix_dedup, op3_best_fit_packing, op4_tool_calls, op5_minhash_near_dedup, op6_winnowing, op7_decontamination, op8_language_id, op9_html_extraction, op10_sharding)}
