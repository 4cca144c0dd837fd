"""Interval jobs on genome coordinates: overlaps, anti-joins, merged regions, annotation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions.bind import let
from readframe.operators.scan import running_before
from readframe.operators.skew import HOT_ROWS, salt_hot_keys
from readframe.session import measured, task_number

PLACE = ["assembly_id", "strand"]


def _bin(column, width: int):
    return F.floor(F.col(column) / width).cast("long") if isinstance(column, str) else F.floor(column / width).cast("long")


def overlap_pairs(
    reads: DataFrame, cds: DataFrame, place: list[str] = PLACE, width: int = 1024, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every (read, CDS) pair that shares a base.

    ``reads`` has read_id, start, end; ``cds`` has cds_start, cds_end; both have the ``place`` columns.  Both sides
    are laid into bins of ``width`` bases and joined on the bin; a pair is kept in the first bin that both touch, so
    no distinct is needed.  Bins with very many reads are salted.
    """
    left = reads.withColumn("_bin", F.explode(F.sequence(_bin("start", width), _bin("end", width))))
    right = cds.withColumn("_bin", F.explode(F.sequence(_bin("cds_start", width), _bin("cds_end", width))))
    left, right = salt_hot_keys(left, right, [*place, "_bin"], "read_id", hot_rows)
    first_shared = F.floor(F.greatest("start", "cds_start") / width).cast("long")
    return (
        left.join(right, [*place, "_bin", "_salt"])
        .filter("start <= cds_end and cds_start <= end")
        .filter(F.col("_bin") == first_shared)
        .drop("_bin", "_salt")
    )


def without_uncertain(
    reads: DataFrame, uncertain: DataFrame, read_length: int, place: list[str] = PLACE, width: int = 1024
) -> DataFrame:
    """Drop reads that start in ``[u.start - read_length, u.end]`` of an uncertain CDS.

    Only the uncertain side is repeated over bins; a read has one start and so one bin.
    """
    low = F.col("cds_start") - read_length
    blocked = (
        uncertain.select(*place, low.alias("_low"), F.col("cds_end").alias("_high"))
        .distinct()
        .withColumn("_bin", F.explode(F.sequence(_bin("_low", width), _bin("_high", width))))
    )

    left = reads.withColumn("_bin", _bin("start", width)).alias("r")
    right = blocked.alias("u")
    same_place = [F.col(f"r.{p}") == F.col(f"u.{p}") for p in [*place, "_bin"]]
    hit = F.col("r.start").between(F.col("u._low"), F.col("u._high"))
    condition = hit
    for part in same_place:
        condition = condition & part
    return left.join(right, condition, "left_anti").drop("_bin")


def attach_cds(
    reads: DataFrame, cds: DataFrame, max_read_length: int, place: list[str] = PLACE, width: int = 4096
) -> DataFrame:
    """Add ``cds``, the (start, end) list of the CDSs that touch each read, in coordinate order.

    The annotation is folded into one list per bin first, wide enough for every read that starts in the bin.  A read
    then meets exactly one row: it is neither repeated nor grouped again.  The list is bounded by the bin: checked
    annotations hold a start and an end once.

    Reads and lists meet on the bin's name as text.  The lists are dealt out by that name anew, after they are made, so
    that adaptive execution finds two plain shuffles and can split the reads of a hot bin over tasks.
    """
    per_bin = (
        cds.select(*place, "cds_start", "cds_end")
        .withColumn(
            "_bin", F.explode(F.sequence(_bin(F.col("cds_start") - max_read_length, width), _bin("cds_end", width)))
        )
        .groupBy(*place, "_bin")
        .agg(
            F.array_sort(
                F.collect_set(F.struct(F.col("cds_start").cast("long").alias("start"), F.col("cds_end").cast("long").alias("end")))
            ).alias("_cds")
        )
        .select(_name(place), "_cds")
    )
    touching = F.filter("_cds", lambda c: (c["start"] <= F.col("end")) & (c["end"] >= F.col("start")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        reads.withColumn("_bin", _bin("start", width))
        .withColumn("_name", _name(place))
        .join(per_bin, "_name", "left")
        .withColumn("cds", F.coalesce(touching, empty))
        .drop("_bin", "_name", "_cds")
    )


def _name(place: list[str]):
    return F.concat_ws("\u0001", *place, F.col("_bin").cast("string")).alias("_name")


def merge_regions(cds: DataFrame, place: list[str], width: int = 65536) -> DataFrame:
    """Union of overlapping intervals per place: (place, region_start, region_end, n_cds)."""
    starts = cds.groupBy(*place, "cds_start").agg(F.max("cds_end").alias("cds_end"), F.count("*").alias("n_cds"))
    bucket = _bin("cds_start", width)
    reach = running_before(starts, place, "cds_start", bucket, {"reach": ("max", "cds_end")})
    opens = F.col("reach").isNull() | (F.col("cds_start") > F.col("reach"))
    marked = reach.withColumn("_open", F.when(opens, F.col("cds_start")))
    owned = running_before(marked, place, "cds_start", bucket, {"_owner": ("max", "_open")})
    region = owned.withColumn("region_start", F.coalesce("_open", "_owner"))
    return region.groupBy(*place, "region_start").agg(
        F.max("cds_end").alias("region_end"), F.sum("n_cds").alias("n_cds")
    )


def check_annotations(annotations: DataFrame, place: list[str] = PLACE) -> DataFrame:
    """Settle conflicting certain CDSs; returns (place, cds_start, cds_end, certain).

    Of CDSs with one start the longest stays, then of CDSs with one end the longest; what is not a multiple of three
    long becomes uncertain.  Uncertain input passes through without its copies.
    """
    # Certain and uncertain rows go through the same two groupings, so that what leads to them runs once: an uncertain
    # row is a group of its own, as both of its ends are keys.  Rows are dealt out by their end to a named number of tasks:
    # that serves the second grouping and the distinct, and tasks that adaptive execution merges would hold many rows.
    is_certain, is_whole = F.col("certain"), (F.pmod(F.col("cds_end") - 2 - F.col("cds_start"), F.lit(3)) == 0)
    longest = (
        annotations.filter("certain is not null")
        .groupBy(*place, "certain", "cds_start", F.when(~is_certain, F.col("cds_end")).alias("_end"))
        .agg(F.max("cds_end").alias("cds_end"))
        .repartition(task_number(annotations), *place, "cds_end")
        .groupBy(*place, "certain", "cds_end", F.when(~is_certain, F.col("cds_start")).alias("_start"))
        .agg(F.min("cds_start").alias("cds_start"))
    )
    return longest.select(*place, "cds_start", "cds_end", (is_certain & is_whole).alias("certain")).distinct()


def classify_annotations(gff: DataFrame) -> DataFrame:
    """CDS rows of a GFF table as (assembly_id, strand, cds_start, cds_end, certain); others are dropped."""
    kind = C.annotation_class(F.col("attributes"))
    return (
        gff.filter("type = 'CDS' and strand in ('+', '-')")
        .withColumn("_kind", kind)
        .filter(F.col("_kind").isNotNull())
        .select(
            F.col("seqid").alias("assembly_id"),
            "strand",
            F.col("start").cast("long").alias("cds_start"),
            F.col("end").cast("long").alias("cds_end"),
            (F.col("_kind") == "certain").alias("certain"),
            *[c for c in gff.columns if c in ("accession", "source_set")],
        )
    )


def assembly_names(records: DataFrame) -> DataFrame:
    """Match assemblies of two sequence sets by length: (accession, from_name, to_name).

    ``records`` has accession, source_rank (0 = the set whose names are kept), ordinal, name, length.  Per length the
    last name in file order is mapped to the first.
    """
    order = F.struct("source_rank", "ordinal")
    per_length = records.groupBy("accession", "length").agg(
        F.max_by("name", order).alias("from_name"), F.min_by("name", order).alias("to_name"), F.max(order).alias("_last")
    )
    # Two lengths can end on one name only if a name is used twice; the later record decides.
    return per_length.groupBy("accession", "from_name").agg(F.max_by("to_name", "_last").alias("to_name"))


def rename_assemblies(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """Give annotations of the second set the assembly names of the first."""
    lookup = measured(names.select("accession", F.col("from_name").alias("assembly_id"), F.col("to_name").alias("_to")))
    return (
        annotations.join(lookup, ["accession", "assembly_id"])
        .withColumn("assembly_id", F.col("_to"))
        .drop("_to")
        .select(*annotations.columns)
    )


def flip_minus_strand(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """Minus-strand CDSs in reverse-complement coordinates; ``lengths`` has assembly_id, length."""
    start, end = F.col("cds_start"), F.col("cds_end")
    minus = F.col("strand") == "-"
    return (
        annotations.join(measured(lengths.select("assembly_id", "length")), "assembly_id")
        .withColumns(
            {
                "cds_start": F.when(minus, F.col("length") - end + 1).otherwise(start),
                "cds_end": F.when(minus, F.col("length") - start + 1).otherwise(end),
            }
        )
        .select(*annotations.columns)
    )


def indels_match_frames(fragments, indels):
    """True unless an indel in the gap of two chained fragments disagrees with their frame step.

    ``fragments`` is an array of (start, end, rf, cds_group) in coordinate order, ``indels`` of (pos, kind).
    """

    def pair_ok(a, b):
        step = F.pmod(b["rf"] - a["rf"], F.lit(3))
        wanted = lambda e: F.when(e["kind"] == "I", step == 1).otherwise(step == 2)
        return F.forall(F.filter(indels, lambda e: e["pos"].between(a["end"], b["start"])), wanted)

    def ok(a, i):
        followers = F.filter(fragments, lambda b, j: (j > i) & (b["cds_group"] == a["cds_group"]))
        following = F.get(followers, F.lit(0))
        return F.when(F.size(followers) == 0, F.lit(True)).otherwise(pair_ok(a, following))

    return F.forall(F.transform(fragments, ok), lambda x: x)


def chunk_sequences(assemblies: DataFrame, overlap: int, width: int = 1024) -> DataFrame:
    """Cut sequences (assembly_id, strand, seq) to rows (.., chunk, chunk_seq) of ``width + overlap`` bases.

    A read joins the one short chunk its start falls into instead of a whole chromosome.  The cut is one pass over the
    sequence; a ``substring`` per chunk would scan it from the first base every time.  A long overlap reaches over
    several of the following chunks.
    """
    pieces = F.regexp_extract_all("seq", F.lit(f"[\\s\\S]{{1,{width}}}"), F.lit(0))
    following = -(-overlap // width)

    def with_overlap(bound):
        def behind(i):
            return F.array_join(F.slice(bound, i + 2, F.lit(following)), "")

        return F.transform(bound, lambda piece, i: F.concat(piece, F.substr(behind(i), F.lit(1), F.lit(overlap))))

    chunks = F.posexplode(let(pieces, with_overlap)).alias("_n", "chunk_seq")
    return assemblies.select("assembly_id", "strand", chunks).select(
        "assembly_id", "strand", F.col("_n").cast("long").alias("chunk"), "chunk_seq"
    )


def matches_reference(reads: DataFrame, chunks: DataFrame, width: int = 1024) -> DataFrame:
    """Add ``is_restored``: does the corrected read equal the reference at its start?

    ``reads`` has assembly_id, strand, start, restored.  A start without reference gives false.
    """
    offset = (F.col("start") - 1 - F.col("chunk") * width + 1).cast("int")
    same = F.substr("chunk_seq", offset, F.length("restored")) == F.col("restored")
    return (
        reads.withColumn("chunk", F.floor((F.col("start") - 1) / width).cast("long"))
        .join(chunks, ["assembly_id", "strand", "chunk"], "left")
        .withColumn("is_restored", F.coalesce(same, F.lit(False)))
        .drop("chunk", "chunk_seq")
    )
