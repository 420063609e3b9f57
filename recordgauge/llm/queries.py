"""The registered queries of the corpus operators, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordgauge.llm import (
    compression_quality,
    nn_descent,
    page_blocks,
    piece_language,
    prefix_trie,
    pu_toxicity,
    quality_rules,
    secret_scan,
    simhash_index,
    source_mixing,
    spelling_variants,
    url_filter,
    window_packing,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept", *quality_rules.MORE
    )


def op3_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.digest(window_packing.pack(_table(spark, sf_dir, "documents")))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept", "fit_error"
    )


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_blocks.extract(pages).drop("html")


def op8_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_language.judge(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.find_secrets(docs))


def op10_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_pu_toxicity,
        op2_quality_rules,
        op3_window_packing,
        op4_nn_descent,
        op5_source_mixing,
        op6_compression_quality,
        op7_page_blocks,
        op8_piece_language,
        op9_secret_scan,
        op10_simhash_index,
        op11_spelling_variants,
        op12_prefix_trie,
        op13_url_filter,
    )
    return {query.__name__: query for query in listed}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql()}
