"""Training-data pipeline over the documents table, from raw documents to packed sequences.

Each stage takes all that the one before it kept.  All but the last return documents with their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readframe.llm import best_fit, cube_mix, line_rules, min_max, secret_links
from readframe.llm.shared import cut, table, tokenizer_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return line_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at a similarity of 0.8 or more, stays."""
    return min_max.first_of_group(docs, min_similarity=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the name of their kind; every document stays."""
    return secret_links.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source may be cut."""
    return cube_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return best_fit.pack_documents(docs, *tokenizer_files())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The tokenizer, the signatures and the sample have no form in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
