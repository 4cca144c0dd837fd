"""Truth and predictions in the shape that evaluation takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions import errors as E
from readframe.operators.evaluate import READ
from readframe.operators.frameshift import gap_indels
from readframe.operators.rejects import kept_rows, with_reason


def _tiers(rows: DataFrame) -> DataFrame:
    """Main CDSs are part of the wide tier too."""
    both = F.when(F.col("_tier") == "main", F.array(F.lit("main"), F.lit("wide"))).otherwise(F.array(F.col("_tier")))
    return rows.filter(F.col("_tier").isNotNull()).withColumn("tier", F.explode(both)).drop("_tier")


def grouped_coordinates(coords: Column, connections: Column) -> Column:
    """(start, end, rf, cds_group) from plain coordinates and chains given as lists of their indexes."""

    def group_of(index: Column) -> Column:
        hit = F.filter(F.transform(connections, lambda c, g: F.struct(c.alias("c"), g.alias("g"))), lambda x: F.array_contains(x["c"], index))
        return F.get(hit, F.lit(0))["g"]

    return F.transform(
        coords, lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rf"].alias("rf"), group_of(i).alias("cds_group"))
    )


def judged_by_cds(reads: DataFrame) -> DataFrame:
    """Add ``reason``: reads without any CDS are no truth."""
    return with_reason(reads, {"no CDS": F.size("cds_coords") > 0})


def truth_cds(reads: DataFrame) -> DataFrame:
    """(tier, testset, accession, read_name, cds_group, fragments, indels) of labelled reads, one row per CDS.

    ``reads`` has testset, accession, read_name, cds_coords (start, end, rf, cds_group) and indel_positions.  The tier
    goes by the span of all fragments; indels are those inside it.
    """
    groups = F.array_distinct(F.transform("cds_coords", lambda c: c["cds_group"]))
    rows = kept_rows(judged_by_cds(reads)).withColumn("cds_group", F.explode(groups)).withColumn(
        "fragments",
        F.transform(
            F.filter("cds_coords", lambda c: c["cds_group"] == F.col("cds_group")),
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rf"].alias("rf")),
        ),
    )
    low = F.array_min(F.transform("fragments", lambda f: f["start"]))
    high = F.array_max(F.transform("fragments", lambda f: f["end"]))
    inside = E.indels_between(E.indel_tokens(F.col("indel_positions")), low, high)
    return _tiers(
        rows.select(
            "testset", "accession", "read_name", "cds_group", "fragments", inside.alias("indels"),
            C.truth_tier(high - low + 1).alias("_tier"),
        )
    )


def predicted_cds(cds: DataFrame) -> DataFrame:
    """As truth_cds for predictions (model, testset, accession, read_name, cds_group, start, end, rf).

    The tier goes by the summed length of the fragments, and indels are placed in the middle of the gaps.
    """
    fragment = F.struct(F.col("start").cast("int"), F.col("end").cast("int"), F.col("rf").cast("int"))
    typed = "array<struct<start:int,end:int,rf:int>>"
    single = cds.filter("cds_group is null").select(*READ, "cds_group", F.array(fragment).cast(typed).alias("fragments"))
    chains = cds.filter("cds_group is not null").groupBy(*READ, "cds_group").agg(F.array_sort(F.collect_list(fragment)).cast(typed).alias("fragments"))
    rows = single.unionByName(chains)
    length = F.aggregate("fragments", F.lit(0), lambda acc, f: acc + f["end"] - f["start"] + 1)
    indels = F.transform(gap_indels(F.col("fragments")), lambda e: F.concat(e["pos"].cast("string"), e["kind"]))
    tier = C.prediction_tier(length, F.size("fragments") > 1)
    return _tiers(rows.select(*READ, "cds_group", "fragments", indels.alias("indels"), tier.alias("_tier")))


def gene_caller_main(cds: DataFrame) -> DataFrame:
    """Gene-caller CDSs above 60 bases."""
    return cds.filter(F.col("end") - F.col("start") + 1 > 60)


def as_cds_table(tiered: DataFrame, tier: str) -> DataFrame:
    """Fragments of one tier as CDS rows; a CDS of one fragment has no group."""
    group = F.when(F.size("fragments") > 1, F.col("cds_group").cast("string"))
    keys = [c for c in READ if c in tiered.columns]
    return tiered.filter(F.col("tier") == tier).select(*keys, group.alias("cds_group"), F.inline("fragments"))


def indel_positions(tiered: DataFrame, tier: str) -> DataFrame:
    """(keys, pos, kind) of the indels of one tier."""
    keys = [c for c in READ if c in tiered.columns]
    token = F.explode("indels").alias("_token")
    rows = tiered.filter(F.col("tier") == tier).select(*keys, token)
    return rows.select(*keys, E.token_position(F.col("_token")).alias("pos"), F.substr("_token", F.length("_token")).alias("kind"))
