"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fastbreak.llm import chat, decontam, gru_lm, license_scan, mixing, ngram_join, prefix_trie, quality, rules, structure_repair, suffix_dedup, token_edit, warc
from fastbreak.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op1_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_warc_bundles(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_source_mixing(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_edit.op5_edit_token_counts(table(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op6_chat_windows(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op7_quality_rules(table(spark, sf_dir, "documents"))


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.op8_gru_scores(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op9_ngram_join(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op10_suffix_dedup(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op11_license_scan(table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.op12_structure_repair(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13_prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc_bundles, op3_source_mixing, op4_quality_classifier, op5_edit_token_counts, op6_chat_windows, op7_quality_rules, op8_gru_scores, op9_ngram_join, op10_suffix_dedup, op11_license_scan, op12_structure_repair, op13_prefix_trie)}
ORACLE_SQL = {"op1_decontamination": decontam.SQL, "op2_warc_bundles": warc.SQL, "op6_chat_windows": chat.SQL, "op7_quality_rules": rules.SQL, "op9_ngram_join": ngram_join.SQL, "op12_structure_repair": structure_repair.SQL, "op13_prefix_trie": prefix_trie.SQL}
