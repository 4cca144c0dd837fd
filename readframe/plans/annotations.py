"""Checked annotations of all genomes in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readframe.operators import intervals as I


def build_annotations(first_set: DataFrame, second_set: DataFrame, records: DataFrame, lengths: DataFrame) -> DataFrame:
    """(assembly_id, strand, cds_start, cds_end, certain) from two GFF tables of the same genomes.

    Both GFF tables also have accession (the same one in both).  ``records`` lists the sequences of both sets for the
    name match, ``lengths`` the assemblies that are kept.
    """
    kept = I.classify_annotations(first_set)
    renamed = I.rename_assemblies(I.classify_annotations(second_set), I.assembly_names(records))
    stacked = kept.unionByName(renamed).drop("accession")
    return I.check_annotations(I.flip_minus_strand(stacked, lengths))
