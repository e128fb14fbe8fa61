"""The registered queries of this package: ``name -> (query, sql or None)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (conversation_repair, inner_product, lexical_search, main_text, mixing, near_lattice, near_minhash, packing, substring,
               token_counts, tool_calls, toxicity, url_lists)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op2_lattice_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.temporal_filter(url_lists.captures_of(pages), url_lists.entries_of(pages))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.messages_of(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, tool_calls.tools_of(spark))


def op8_norm_sorted_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_products(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "spans")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_cost_packing": (op1_cost_packing, None),
    "op2_lattice_near_vectors": (op2_lattice_near_vectors, near_lattice.SQL),
    "op3_temporal_url_lists": (op3_temporal_url_lists, url_lists.SQL),
    "op4_main_text": (op4_main_text, None),
    "op5_minhash_near_duplicates": (op5_minhash_near_duplicates, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_tool_call_linking": (op7_tool_call_linking, tool_calls.SQL),
    "op8_norm_sorted_top_products": (op8_norm_sorted_top_products, inner_product.SQL),
    "op9_substring_dedup": (op9_substring_dedup, substring.SQL),
    "op10_source_mixing": (op10_source_mixing, mixing.SQL),
    "op11_lexical_search": (op11_lexical_search, lexical_search.SQL),
    "op12_conversation_repair": (op12_conversation_repair, conversation_repair.SQL),
    "op13_token_counts": (op13_token_counts, None),
}
