"""CIGAR, MD and error-list strings of aligned reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readframe.functions.bind import let

# The token patterns of the three string formats.
CIGAR_TOKEN = r"(\d+)([MID])"
MD_TOKEN = r"\d+|\^[A-Z]+|[A-Z]"
INDEL_TOKEN = r"\d+[ID]"
QUERY_TOKEN = r"(\d+)([MISX=])"


def parse_cigar(cigar: Column) -> Column:
    """Array of (op, len) for the M, I and D operations."""
    lengths = F.regexp_extract_all(cigar, F.lit(CIGAR_TOKEN), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(CIGAR_TOKEN), F.lit(2))
    return F.zip_with(ops, lengths, lambda op, n: F.struct(op.alias("op"), n.cast("int").alias("len")))


def read_length_from_cigar(cigar: Column) -> Column:
    """Bases of the read that a CIGAR string covers; NULL counts as 0."""
    lengths = F.regexp_extract_all(cigar, F.lit(QUERY_TOKEN), F.lit(1))
    total = F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n.cast("int"))
    return F.coalesce(total, F.lit(0))


def count_substitutions(md: Column) -> Column:
    """Substituted bases in an MD string: letters that are not part of a ``^`` deletion."""
    kept = F.regexp_replace(F.regexp_replace(md, r"\^[ACGT]+", ""), "[^ACGT]", "")
    return F.coalesce(F.length(kept), F.lit(0))


def count_indels(indels: Column) -> Column:
    return F.coalesce(F.regexp_count(indels, F.lit("[ID]")), F.lit(0))


def indel_tokens(indels: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(indels, F.lit(INDEL_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_position(token: Column) -> Column:
    return F.regexp_extract(token, r"^(\d+)", 1).cast("int")


def indels_between(tokens: Column, low: Column, high: Column) -> Column:
    return F.filter(tokens, lambda t: token_position(t).between(low, high))


def _error(position: Column, kind: Column) -> Column:
    return F.struct(position.cast("int").alias("pos"), kind.alias("kind"))


def errors_from_md(md: Column, read_length: Column, insertions: Column) -> Column:
    """Array of (pos, kind): insertions first, then substitutions and deletions in MD order.

    ``insertions`` holds 0-based positions.  A substitution keeps the reference base as its kind.  A deletion
    run ``^ACG`` is one error, and its position is lowered by the deletions before it.  Errors past the read end
    are left out.
    """
    tokens = F.regexp_extract_all(md, F.lit(MD_TOKEN), F.lit(0))
    empty = F.array().cast("array<struct<pos:int,kind:string>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("deletions"), empty.alias("errors"))

    def step(state: Column, token: Column) -> Column:
        is_count = token.rlike("^[0-9]")
        is_deletion = token.startswith("^")
        inside = state["pos"] <= read_length
        error = F.when(is_deletion, _error(state["pos"] + 1 - state["deletions"], F.lit("D"))).otherwise(
            _error(state["pos"] + 1, token)
        )
        size = F.when(is_count, token.cast("int")).when(is_deletion, F.length(token) - 1).otherwise(1)
        return F.struct(
            (state["pos"] + size).alias("pos"),
            (state["deletions"] + (is_deletion & inside).cast("int")).alias("deletions"),
            F.when(~is_count & inside, F.concat(state["errors"], F.array(error))).otherwise(state["errors"]).alias("errors"),
        )

    from_md = F.aggregate(tokens, start, step, lambda state: state["errors"])
    inserted = F.transform(insertions, lambda p: _error(p + 1, F.lit("I")))
    return F.when(md == read_length.cast("string"), empty).otherwise(F.concat(inserted, F.coalesce(from_md, empty)))


def error_string(errors: Column) -> Column:
    """``38I,73D`` form of an error array."""
    return F.array_join(F.transform(errors, lambda e: F.concat(e["pos"].cast("string"), e["kind"])), ",")


def has_deletion(md: Column) -> Column:
    """The substitution-only data set takes no read with a deletion."""
    return F.coalesce(F.contains(md, F.lit("^")), F.lit(False))


def only_indels(errors: Column) -> Column:
    return F.filter(errors, lambda e: e["kind"].isin("I", "D"))


def shift_by_indels(errors: Column) -> Column:
    """Errors in position order, moved by the indels before them (+1 per I, -1 per D).

    The second of two deletions at neighbouring positions is dropped.
    """
    ordered = F.array_sort(errors)
    empty = F.array().cast("array<struct<pos:int,kind:string>>")
    start = F.struct(
        F.lit(0).alias("delta"), F.lit(None).cast("int").alias("kept_deletion"), empty.alias("errors")
    )

    def step(state: Column, error: Column) -> Column:
        is_deletion = error["kind"] == "D"
        repeated = is_deletion & F.coalesce(error["pos"] == state["kept_deletion"] + 1, F.lit(False))
        change = F.when(error["kind"] == "I", 1).when(is_deletion, -1).otherwise(0)
        moved = F.array(_error(error["pos"] + state["delta"], error["kind"]))
        return F.when(repeated, state).otherwise(
            F.struct(
                (state["delta"] + change).alias("delta"),
                F.when(is_deletion, error["pos"]).alias("kept_deletion"),
                F.concat(state["errors"], moved).alias("errors"),
            )
        )

    return F.aggregate(ordered, start, step, lambda state: state["errors"])


def restore_substitutions(seq: Column, errors: Column) -> Column:
    """Put the reference base back at every substituted position; the last error at a position wins."""
    letters = F.regexp_extract_all(seq, F.lit(r"[\s\S]"), F.lit(0))

    def restored(wanted: Column) -> Column:
        def at(letter: Column, index: Column) -> Column:
            here = F.filter(wanted, lambda e: e["pos"] == index + 1)
            return F.coalesce(F.try_element_at(here, F.lit(-1))["kind"], letter)

        return F.when(F.size(wanted) == 0, seq).otherwise(F.array_join(F.transform(letters, at), ""))

    return let(F.filter(errors, lambda e: e["kind"].isin("A", "C", "G", "T")), restored)


def nominal_rates(dataset: Column) -> tuple[Column, Column]:
    """(indel rate, substitution rate) spelled out in a data set name; NULL where there is none."""
    pattern = r"([0-9.e-]+)i_([0-9.e-]+)s"
    return tuple(F.regexp_extract(dataset, pattern, group).try_cast("double") for group in (1, 2))


def nominal_read_length(dataset: Column) -> Column:
    return F.regexp_extract(dataset, r"(\d+)bp$", 1).try_cast("int")
