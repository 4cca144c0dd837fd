"""Per-codon label arrays.

Labels: 0 non-coding, 1 coding, 2 start codon, 3 stop codon, 4 first codon after an indel, 5 last codon before one.
A label's neighbours decide where a run opens and closes, so runs come out of two filtered index lists instead of a
sequential fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readframe.functions.bind import let

# Labels that may follow a label, for six and for four classes.
LEGAL_SIX = {0: (0, 2, 4), 1: (1, 3, 5), 2: (1, 5), 3: (0, 2, 4), 4: (1, 3, 5), 5: (0, 2, 4)}
LEGAL_FOUR = {0: (0, 2), 1: (1, 3), 2: (1,), 3: (0, 2)}

SEGMENT_TYPE = "array<struct<start:int,end:int,frame:int,start_type:string,end_type:string>>"
INTERVAL_TYPE = "array<struct<start:int,end:int,rf:int>>"
CDS_TYPE = "array<struct<start:int,end:int>>"


def _indices(labels: Column) -> Column:
    """0 .. n-1, or an empty array."""
    n = F.size(labels)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _at(labels: Column, index: Column) -> Column:
    """Label at a 0-based index, NULL outside."""
    return F.get(labels, index)


def mark_indel_borders(labels: Column) -> Column:
    """The first 1 after a 0 becomes 4; a 1 before a 0 that is not such a first one becomes 5."""

    def border(x: Column, i: Column, bound: Column) -> Column:
        opens = F.coalesce(_at(bound, i - 1) == 0, F.lit(False))
        closes = F.coalesce(_at(bound, i + 1) == 0, F.lit(False))
        marked = F.when(x != 1, x).when(opens, 4).when(closes, 5).otherwise(x)
        return marked.cast("tinyint")

    return let(labels, lambda bound: F.transform(bound, lambda x, i: border(x, i, bound)))


def codon_labels(nt_labels: Column) -> Column:
    """One label per codon: 0 if any of its bases is 0, else that of its first base."""

    def per_codon(bound: Column) -> Column:
        n = F.size(bound)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(3))).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            broken = (_at(bound, i) == 0) | (_at(bound, i + 1) == 0) | (_at(bound, i + 2) == 0)
            return F.when(broken, F.lit(0)).otherwise(_at(bound, i)).cast("tinyint")

        return F.when(bound.isNotNull(), F.transform(starts, one))

    return let(nt_labels, per_codon)


def pad_labels(labels: Column, length: Column | int) -> Column:
    """Filled up to a length with -1; labels beyond it are cut, as an explicit length asks for."""
    length = F.lit(length) if isinstance(length, int) else length
    kept = F.slice(labels, F.lit(1), length)
    return F.concat(kept, F.array_repeat(F.lit(-1).cast("tinyint"), length - F.size(kept)))


def valid_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != -1)


def trim_labels(labels: Column, length: Column) -> Column:
    return F.slice(labels, F.lit(1), length)


def trim_at_eos(labels: Column, tokens: Column, eos: int) -> Column:
    """Labels up to the residue before the end-of-sequence token (tokens start with CLS); at least one label."""
    position = F.array_position(tokens, eos).cast("int")
    found = F.when(position > 0, position - 2).otherwise(F.size(labels))
    return F.slice(labels, F.lit(1), F.greatest(found, F.lit(1)))


def segments(labels: Column, frame: Column | int) -> Column:
    """Runs of coding labels in one frame as (start, end, frame, start_type, end_type), 1-based inclusive."""
    return let(labels, lambda bound: _segments(bound, frame))


def _segments(labels: Column, frame: Column | int) -> Column:
    def inside(i: Column) -> Column:
        return F.coalesce(_at(labels, i).isin(1, 2, 4), F.lit(False))

    idx = _indices(labels)
    opens = F.filter(idx, lambda i: inside(i) & ~inside(i - 1))
    # One past the last label closes a run that is still open.
    shuts = F.filter(F.concat(idx, F.array(F.size(labels))), lambda i: ~inside(i) & inside(i - 1))

    def run(first: Column, after: Column) -> Column:
        opening, closing = _at(labels, first), _at(labels, after)
        takes_codon = F.coalesce(closing.isin(3, 5), F.lit(False))
        return F.struct(
            (first * 3 + frame + 1).cast("int").alias("start"),
            (F.when(takes_codon, after + 1).otherwise(after) * 3 + frame).cast("int").alias("end"),
            F.lit(frame).alias("frame"),
            F.when(opening == 2, "start_codon").when(opening == 4, "indel_start").otherwise("internal_region").alias("start_type"),
            F.when(closing == 3, "stop_codon").when(closing == 5, "indel_stop").otherwise("internal_region").alias("end_type"),
        )

    return F.zip_with(opens, shuts, run).cast(SEGMENT_TYPE)


def truth_intervals(labels: Column, frame: Column | int) -> Column:
    """Runs of start/coding labels up to and with a stop as (start, end, rf); a lone stop is a 3-base interval."""
    return let(labels, lambda bound: _truth_intervals(bound, frame))


def _truth_intervals(labels: Column, frame: Column | int) -> Column:

    def body(i: Column) -> Column:
        return F.coalesce(_at(labels, i).isin(1, 2), F.lit(False))

    def stop(i: Column) -> Column:
        return F.coalesce(_at(labels, i) == 3, F.lit(False))

    idx = _indices(labels)
    opens = F.filter(idx, lambda i: (body(i) | stop(i)) & ~body(i - 1))
    shuts = F.filter(idx, lambda i: stop(i) | (body(i) & ~body(i + 1) & ~stop(i + 1)))
    return F.zip_with(
        opens,
        shuts,
        lambda first, last: F.struct(
            (first * 3 + frame + 1).cast("int").alias("start"),
            ((last + 1) * 3 + frame).cast("int").alias("end"),
            F.lit(frame).alias("rf"),
        ),
    ).cast(INTERVAL_TYPE)


def in_all_frames(columns: list[str], runs) -> Column:
    """``runs(labels, frame)`` of the three frames' label columns in one array."""
    return F.flatten(F.transform(F.array(*[F.col(c) for c in columns]), runs))


def coding_fragments(residues: Column, labels: Column) -> Column:
    """Residue strings under each run of label 1; ``residues`` is an array of letters."""
    return let(residues, lambda r: let(labels, lambda x: _coding_fragments(r, x)))


def _coding_fragments(residues: Column, labels: Column) -> Column:

    def coding(i: Column) -> Column:
        return F.coalesce(_at(labels, i) == 1, F.lit(False))

    idx = _indices(labels)
    opens = F.filter(idx, lambda i: coding(i) & ~coding(i - 1))
    shuts = F.filter(idx, lambda i: coding(i) & ~coding(i + 1))
    return F.zip_with(opens, shuts, lambda a, b: F.array_join(F.slice(residues, a + 1, b - a + 1), ""))


def _paint(cds: Column, first_base: Column, n: Column, step: int) -> Column:
    """Labels of ``n`` places, ``step`` bases apart, from the CDSs of one frame in list order.

    Each CDS is laid over the array as three stretches.  Its start and stop replace what is there, coding only fills 0;
    a later CDS therefore wins among starts and stops.
    """
    codon = 3 // step

    def stretch(low: Column, high: Column, value: int) -> Column:
        return F.array_repeat(F.lit(value), F.greatest(high - low + 1, F.lit(0)).cast("int"))

    def kept(labels: Column, low: Column, high: Column) -> Column:
        return F.slice(labels, (low + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))

    def lay(labels: Column, c: Column) -> Column:
        s0, e1 = F.floor((c["start"] - first_base) / step), F.floor((c["end"] - first_base) / step)
        ends = F.struct(s0.alias("s0"), e1.alias("e1"), (n - 1).alias("last"))
        return let(ends, lambda e: let(borders(e), lambda b: laid(labels, b)))

    def borders(e: Column) -> Column:
        s1 = F.least(e["s0"] + codon - 1, e["e1"])
        e0 = F.greatest(e["e1"] - codon + 1, s1 + 1)
        return F.struct(e["s0"].alias("s0"), s1.alias("s1"), e0.alias("e0"), e["e1"].alias("e1"), e["last"].alias("last"))

    def laid(labels: Column, b: Column) -> Column:
        zero = F.lit(0)
        inner = kept(labels, F.greatest(b["s1"] + 1, zero), F.least(b["e0"] - 1, b["last"]))
        whole = F.concat(
            kept(labels, zero, b["s0"] - 1),
            stretch(F.greatest(b["s0"], zero), F.least(b["s1"], b["last"]), 2),
            F.transform(inner, lambda x: F.when(x == 0, 1).otherwise(x)),
            stretch(F.greatest(b["e0"], zero), F.least(b["e1"], b["last"]), 3),
            kept(labels, F.greatest(b["e1"] + 1, zero), b["last"]),
        )
        return F.when((b["e1"] < 0) | (b["s0"] > b["last"]), labels).otherwise(whole)

    return F.aggregate(cds, F.array_repeat(F.lit(0), n.cast("int")), lay)


def _in_frame(cds: Column, frame_start: Column) -> Column:
    return F.filter(cds, lambda c: F.pmod(c["start"] - frame_start, F.lit(3)) == 0)


def frame_labels(read_start: Column, read_length: Column, cds: Column, frame: Column | int) -> Column:
    """Codon labels of an indel-free read in one frame; ``cds`` holds (start, end) in genome coordinates.

    The label of a codon is that of its first base.
    """
    frame_start = (read_start + frame).cast("long")
    n = F.floor((read_length - frame) / 3).cast("int")
    return F.transform(_paint(_in_frame(cds, frame_start), frame_start, n, 3), lambda x: x.cast("tinyint"))


def _matched_pieces(ops: Column, frame: Column | int) -> Column:
    """(op, from, to, shift) per operation: labelled positions from <= j < to, and the CDS shift in force.

    The frame offset is taken from the first operation; an operation with nothing left is skipped.
    """
    kept = F.filter(
        F.transform(ops, lambda o, i: F.struct(o["op"].alias("op"), F.when(i == 0, o["len"] - frame).otherwise(o["len"]).alias("len"))),
        lambda o: o["len"] >= 1,
    )
    empty = F.array().cast("array<struct<op:string,from:int,to:int,shift:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("shift"), empty.alias("pieces"))

    def step(state: Column, o: Column) -> Column:
        moves = o["op"].isin("M", "I")
        after = F.when(moves, state["at"] + o["len"]).otherwise(state["at"])
        piece = F.struct(o["op"].alias("op"), state["at"].alias("from"), after.alias("to"), state["shift"].alias("shift"))
        change = F.when(o["op"] == "I", o["len"]).when(o["op"] == "D", -o["len"]).otherwise(0)
        return F.struct(
            after.alias("at"),
            (state["shift"] + change).alias("shift"),
            F.when(moves, F.concat(state["pieces"], F.array(piece))).otherwise(state["pieces"]).alias("pieces"),
        )

    return F.aggregate(kept, start, step, lambda state: state["pieces"])


def nt_labels_with_indels(read_start: Column, read_length: Column, cds: Column, ops: Column, frame: Column | int) -> Column:
    """Base labels of one frame of a read with insertions and deletions.

    CDSs move by +len at an insertion and -len at a deletion; inserted bases are 0.  NULL if the CIGAR covers fewer
    bases than the frame holds.
    """
    frame_start = (read_start + frame).cast("long")
    wanted = (F.floor((read_length - frame) / 3) * 3).cast("int")

    def piece_labels(p: Column) -> Column:
        in_frame = _in_frame(cds, frame_start - p["shift"])
        painted = _paint(in_frame, frame_start - p["shift"] + p["from"], p["to"] - p["from"], 1)
        return F.when(p["op"] == "M", painted).otherwise(F.array_repeat(F.lit(0), p["to"] - p["from"]))

    labels = F.slice(F.flatten(F.transform(_matched_pieces(ops, frame), piece_labels)), F.lit(1), wanted)
    return let(labels, lambda bound: F.when(F.size(bound) == wanted, bound))


def insertion_positions(ops: Column) -> Column:
    """0-based read positions of inserted bases."""
    inserted = F.filter(_matched_pieces(ops, 0), lambda p: p["op"] == "I")
    return F.flatten(F.transform(inserted, lambda p: F.sequence(p["from"], p["to"] - 1)))


def sequence_type(
    labels: list[Column], has_indel: Column, has_cds: Column, has_substitutions: Column
) -> Column:
    """First of seven descriptions that fits a labelled read."""

    def any_has(value: int) -> Column:
        hits = [F.array_contains(frame, F.lit(value).cast("tinyint")) for frame in labels]
        return hits[0] | hits[1] | hits[2]

    zero, one = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    mixed = [F.array_contains(frame, zero) & F.array_contains(frame, one) for frame in labels]
    return (
        F.when(has_indel & (mixed[0] | mixed[1] | mixed[2]), "transition_indel")
        .when(any_has(2) & any_has(3), "transition_start_stop")
        .when(any_has(2), "transition_start")
        .when(any_has(3), "transition_stop")
        .when(~has_cds, "non-coding")
        .when(has_substitutions, "coding_with_substitutions")
        .otherwise("coding")
    )
