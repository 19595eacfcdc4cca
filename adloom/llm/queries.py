"""Registered queries of the text operators: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adloom.llm import (chunk_bpe, jaccard, langid, neighbours, oracle, packing, prefix_trie, quality, repair, substring, token_counts,
                        toxicity, url_filter, warc)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90).drop("class_id")


def op3_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(table(spark, sf_dir, "documents"), window=20)


def op4_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def op9_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_lexical_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op12_count_min_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_sorted_stream_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sum_of_squares_packing, op2_token_group_jaccard, op3_relative_lz_dedup, op4_whole_token_counts, op5_toxicity_chain,
              op6_chunk_reuse_bpe, op7_posting_list_neighbours, op8_line_first_cleaning, op9_gzip_normaliser,
              op10_hyperdimensional_langid, op11_lexical_url_trees,
              op12_count_min_prefix_trie, op13_sorted_stream_repair)
}
ORACLE_SQL: dict[str, str] = {
    "op2_token_group_jaccard": oracle.JACCARD,
    "op3_relative_lz_dedup": oracle.SUBSTRING,
    "op8_line_first_cleaning": oracle.QUALITY,
    "op9_gzip_normaliser": oracle.WARC,
}
