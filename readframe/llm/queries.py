"""One query per operator, with production parameters over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from readframe.llm import best_fit, cube_mix, html_layout, interval_dedup, katz, line_rules, merkle, min_max, multi_index, prefix_trie, secret_links, substring_trees, tree_oracles, url_rules
from readframe.llm.oracles import ORACLES
from readframe.llm.shared import table, tokenizer_files


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(table(spark, sf_dir, "documents"))


def op3_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.find_secrets(table(spark, sf_dir, "documents"))


def op5_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op7_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.remove_repeated_words(table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"))


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.RULES)



def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op12_bitmap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))



def op13_block_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


RUNS = [op1_best_fit, op2_line_frequency, op3_interval_dedup, op4_secret_links, op5_min_max, op6_html_layout, op7_substring_trees, op8_multi_index, op9_cube_mix, op10_url_rules, op11_katz_backoff, op12_bitmap_manifest, op13_block_trie]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {run.__name__: run for run in RUNS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | tree_oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
