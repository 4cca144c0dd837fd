"""Coordinates and attributes of coding sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# GC bin edges in percent, and families read with translation table 4.
GC_EDGES = (0, 40, 50, 60, 100)
TABLE_FOUR_FAMILIES = ("Mycoplasmataceae",)
# Annotation notes that make a CDS uncertain, and the word that drops it.
UNCERTAIN_NOTES = (
    "pseudo=true",
    "product=hypothetical protein",
    "partial=true",
    "ab initio prediction",
    "note=programmed frameshift",
)
PSEUDOGENE = "pseudogene"


def annotation_class(attributes: Column) -> Column:
    """``uncertain``, ``certain``, or NULL for annotations that are dropped."""
    text = F.lower(attributes)
    uncertain = reduce(lambda a, b: a | b, [F.contains(text, F.lit(note)) for note in UNCERTAIN_NOTES])
    return F.when(uncertain, "uncertain").when(~F.contains(text, F.lit(PSEUDOGENE)), "certain")


def frame_of_start(start: Column) -> Column:
    return F.pmod(start - 1, F.lit(3)).cast("int")


def indel_type(from_frame: Column, to_frame: Column) -> Column:
    """``insertion`` if the frame goes up by one (mod 3), ``deletion`` if down, NULL if it stays."""
    step = F.pmod(to_frame - from_frame, F.lit(3))
    return F.when(step == 1, "insertion").when(step == 2, "deletion")


def start_codon_span(strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    plus = strand == "+"
    return F.when(plus, start).otherwise(end - 2), F.when(plus, start + 2).otherwise(end)


def stop_codon_span(strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    plus = strand == "+"
    return F.when(plus, end - 2).otherwise(start), F.when(plus, end).otherwise(start + 2)


def merge_fragments(fragments: Column, indels: Column) -> Column:
    """Join fragments of one CDS: nothing at an insertion, ``NNN`` at a deletion.

    ``indels`` holds the type of the gap before each fragment; the first one is not read.
    """
    pieces = F.transform(
        fragments,
        lambda f, i: F.when((i > 0) & (F.get(indels, i) == "deletion"), F.concat(F.lit("NNN"), f)).otherwise(f),
    )
    return F.array_join(pieces, "")


def truth_tier(span: Column) -> Column:
    """``main`` above 60 bases, ``wide`` above 30, else NULL."""
    return F.when(span > 60, "main").when(span > 30, "wide")


def prediction_tier(length: Column, is_chain: Column) -> Column:
    """As truth_tier, but a single CDS of exactly 30 bases is still ``wide``."""
    return F.when(length > 60, "main").when((length > 30) | (~is_chain & (length == 30)), "wide")


def gc_bin(gc: Column, edges: tuple = GC_EDGES) -> Column:
    """Label of the half-open bin [low, high); NULL outside."""
    bins = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        bins = F.when((gc >= low) & (gc < high), F.lit(f"{low}-{high}")).otherwise(bins)
    return bins


def translation_table(family: Column) -> Column:
    return F.when(family.isin(*TABLE_FOUR_FAMILIES), 4).otherwise(11)


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def span_iou(s1: Column, e1: Column, rf1: Column, s2: Column, e2: Column, rf2: Column) -> Column:
    """Overlap over union of two spans, lengths as ``end - start``; 0 in different frames."""
    shared = span_overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - shared
    return F.when((rf1 == rf2) & (union > 0), shared / union).otherwise(F.lit(0.0))


def _spans_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])


def _shared_length(left: Column, right: Column) -> Column:
    def per_span(acc: Column, a: Column) -> Column:
        def per_other(inner: Column, b: Column) -> Column:
            shared = span_overlap(a["start"], a["end"], b["start"], b["end"])
            return inner + F.when(a["rf"] == b["rf"], shared).otherwise(0)

        return acc + F.aggregate(right, F.lit(0), per_other)

    return F.aggregate(left, F.lit(0), per_span)


def fragment_iou(pred: Column, truth: Column) -> Column:
    """IoU of two CDSs given as arrays of (start, end, rf) fragments; one fragment means an unbroken CDS.

    An unbroken prediction against a broken truth is held against the truth's fragments in its own frame only; in
    every other case all fragments count.
    """
    own_frame = F.filter(truth, lambda t: t["rf"] == F.get(pred, F.lit(0))["rf"])
    one_sided = (F.size(pred) == 1) & (F.size(truth) > 1)
    shared = _shared_length(pred, truth)
    truth_length = F.when(one_sided, _spans_length(own_frame)).otherwise(_spans_length(truth))
    union = _spans_length(pred) + truth_length - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def is_internal_start(start: Column, rf: Column) -> Column:
    """The CDS runs in from before the read; a broken CDS (rf NULL) is internal at any of the three first bases."""
    return F.when(rf.isNull(), start.between(1, 3)).otherwise(start == rf + 1)


def is_internal_stop(end: Column, read_length: Column) -> Column:
    return end >= read_length - 2


def newick_name(name: Column) -> Column:
    """Names for tree files: brackets squared, separators and blanks to underscores, quotes dropped."""
    return F.translate(name, "(),:; '\"", "[]____")
