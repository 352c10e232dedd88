"""Queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bit_search, bpe_automaton, chained_passages, embedding_dedup, exact_substrings, lexical_search, line_dedup, packing, perplexity, quality_model, simhash, simple8b, spelling_groups
from .common import table
from .token_cache import default_path


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip_digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json")).drop("same_text")


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"), ["doc_id"], from_files=True).drop("low", "high")


def op4_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.written_and_read(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op7_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained_passages.passages(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_search.neighbours(table(spark, sf_dir, "embeddings"))


def op13_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.grouped(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_network": op1_byte_network,
        "op2_bpe_automaton": op2_bpe_automaton,
        "op3_perplexity_rules": op3_perplexity_rules,
        "op4_simple8b_ids": op4_simple8b_ids,
        "op5_line_windows": op5_line_windows,
        "op6_projection_passes": op6_projection_passes,
        "op7_chained_passages": op7_chained_passages,
        "op8_packing": op8_packing,
        "op9_suffix_arrays": op9_suffix_arrays,
        "op10_covering_simhash": op10_covering_simhash,
        "op11_reversed_search": op11_reversed_search,
        "op12_one_bit_codes": op12_one_bit_codes,
        "op13_trie_frontier": op13_trie_frontier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_windows": line_dedup.SQL, "op11_reversed_search": lexical_search.SQL, "op13_trie_frontier": spelling_groups.SQL}
