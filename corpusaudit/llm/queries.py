"""The registered queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, lexical, neardup, ordermin, quality, repeats, sharding, simhash, sql, toolcalls, training_order, trie
from .registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


@query("op8_jump_shards", sql.JUMP_SHARDS)
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_run_index_dedup")
def op7_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates", sql.NEAR_DUPLICATES)
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, similar=(85, 100)).drop("text_md5")


@query("op6_benchmark_fm_index", sql.BENCHMARK)
def op6_benchmark_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("op9_order_min_hash")
def op9_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.order_min_hash(table(spark, sf_dir, "documents"))


@query("op2_training_order")
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), key=20240131)


@query("op2_training_order_tokens")
def op2_training_order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), key=20240131,
                                      ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query("op4_language_fusion")
def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op5_tool_calls", sql.TOOL_CALLS)
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is a call, with its whole text as an argument; every user turn that follows one is its result."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    calls, results, schemas = (spark.sql(t) for t in (sql.CALLS, sql.RESULTS, sql.SCHEMAS))
    return toolcalls.link_calls(calls, results, schemas)


@query("op11_aho_corasick_search", sql.LEXICAL)
def op11_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash_variants")
def op12_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_centroid_trie", sql.PREFIX_TRIE)
def op13_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
