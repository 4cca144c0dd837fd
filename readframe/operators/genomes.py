"""Genome-level numbers and error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readframe.functions import errors as E
from readframe.functions import sequence as S
from readframe.operators.intervals import merge_regions


def composition(records: DataFrame) -> DataFrame:
    """Length in bases and kilobases and GC percent per accession over its sequences (accession, seq)."""
    counted = records.groupBy("accession").agg(
        F.sum(F.length("seq").cast("long")).alias("genome_length"),
        F.sum(S.count_bases(F.col("seq"), "CG")).alias("_gc"),
        F.sum(S.count_bases(F.col("seq"), "AT")).alias("_at"),
    )
    gc = F.round(F.try_divide(F.col("_gc").cast("double"), (F.col("_gc") + F.col("_at")).cast("double")) * 100, 1)
    return counted.select(
        "accession", "genome_length", F.floor(F.col("genome_length") / 1000).cast("int").alias("genome_length_kb"), gc.alias("gc_content")
    )


def gene_numbers(cds: DataFrame) -> DataFrame:
    """CDS count, median length (cut to an integer) and bases under some CDS per accession.

    ``cds`` has accession, landmark, cds_start, cds_end.  CDS lengths are integers of limited range, which bounds the
    exact median's counters.
    """
    length = F.col("cds_end") - F.col("cds_start") + 1
    genes = cds.groupBy("accession").agg(
        F.count("*").cast("int").alias("protein_coding_genes"), F.percentile(length, 0.5).cast("int").alias("cds_median_length")
    )
    merged = merge_regions(cds, ["accession", "landmark"])
    covered = merged.groupBy("accession").agg(F.sum(F.col("region_end") - F.col("region_start") + 1).alias("coding_length"))
    return genes.join(covered, "accession")


def genome_table(ranks: DataFrame, records: DataFrame, cds: DataFrame) -> DataFrame:
    """Genomes with a family: ranks, GC, size, coding percentage and gene numbers."""
    numbers = composition(records).join(gene_numbers(cds), "accession")
    share = F.round(F.try_divide(F.col("coding_length").cast("double"), F.col("genome_length").cast("double")) * 100, 2)
    numbers = numbers.withColumn("coding_percentage", share)
    return ranks.filter(F.col("family").isNotNull()).join(numbers.drop("coding_length", "genome_length"), "accession")


def reads_to_draw(records: DataFrame, read_length: int, coverage: float = 1.0) -> DataFrame:
    """Reads per accession that cover its sequences ``coverage`` times."""
    sizes = records.groupBy("accession").agg(F.sum(F.length("seq").cast("long")).alias("genome_length"))
    return sizes.withColumn("n_reads", S.reads_for_coverage(F.col("genome_length"), read_length, coverage))


def error_counts(reads: DataFrame) -> DataFrame:
    """Substitutions, indels and length of each aligned read (MD, indel_positions, CIGAR)."""
    return reads.withColumns(
        {
            "substitutions": E.count_substitutions(F.col("MD")),
            "indels": E.count_indels(F.col("indel_positions")),
            "length": E.read_length_from_cigar(F.col("CIGAR")),
        }
    )


def error_report(reads: DataFrame) -> DataFrame:
    """Observed and nominal error rates per data set."""
    nominal_indel, nominal_sub = E.nominal_rates(F.col("dataset"))
    bases = F.sum("length").cast("double")
    rate = lambda n: F.coalesce(F.try_divide(F.sum(n).cast("double"), bases), F.lit(0.0))
    return (
        error_counts(reads)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("n_reads"),
            rate("substitutions").alias("substitution_rate"),
            rate("indels").alias("indel_rate"),
            F.avg("substitutions").alias("mean_substitutions"),
            F.max("substitutions").alias("max_substitutions"),
            F.avg("indels").alias("mean_indels"),
            F.max("indels").alias("max_indels"),
        )
        .withColumns({"nominal_indel_rate": nominal_indel, "nominal_substitution_rate": nominal_sub})
    )


def error_histogram(reads: DataFrame) -> DataFrame:
    """Reads per data set, error kind and number of errors."""
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n_errors")) for kind in ("substitutions", "indels")]
    )
    return error_counts(reads).select("dataset", F.inline(kinds)).groupBy("dataset", "kind", "n_errors").agg(F.count("*").alias("n_reads"))
