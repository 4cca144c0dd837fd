"""Nucleotide and protein string columns.

Every function stays inside the JVM.  A codon list is cut with one linear regular-expression pass, because
``substring`` inside a lambda rescans the string from its first byte and so costs O(n^2) on long reads.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from readframe.functions.bind import let
from readframe.functions.draws import happens

# The standard genetic code, codons in T, C, A, G order, and the letters the cleaning step allows.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STANDARD_LETTERS = "ACGTNRYSWKMBDHV"
MIN_READ_LENGTH = 30
SHORT_READ_LENGTH = 300
UNKNOWN_RESIDUE = "<unk>"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; case is kept and letters other than A, C, G, T, N pass through."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def normalise(seq: Column) -> Column:
    """Upper case, RNA to DNA."""
    return F.translate(F.upper(seq), "U", "T")


def is_long_enough(seq: Column, min_length: int = MIN_READ_LENGTH) -> Column:
    return F.length(seq) >= min_length


def has_nonstandard_letter(seq: Column) -> Column:
    return seq.rlike(f"[^{STANDARD_LETTERS}]")


def mask_nonstandard(seq: Column, strict: bool = False) -> Column:
    """Turn every letter but A, C, G, T into N, if some letter is outside the IUPAC set (always, if strict)."""
    masked = F.regexp_replace(seq, "[^ACGT]", "N")
    if strict:
        return masked
    return F.when(has_nonstandard_letter(seq), masked).otherwise(seq)


def codons(seq: Column) -> Column:
    """Whole codons of a sequence as an array; one or two letters left over at the end are dropped."""
    return F.regexp_extract_all(seq, F.lit(r"[\s\S]{3}"), F.lit(0))


def amino_acid(codon: Column, stop: str, unknown: str) -> Column:
    """One codon to its residue: its place in the text of all codons points into a list of residues.

    Codons lie four letters apart; at all other places, and at 0 for not found, the list holds ``unknown``.
    """
    text = " ".join("".join(c) for c in product(BASES, repeat=3))
    at = {4 * i + 1: stop if residue == "*" else residue for i, residue in enumerate(AMINO_ACIDS)}
    return F.get(F.array(*[F.lit(at.get(i, unknown)) for i in range(len(text) + 1)]), F.instr(F.lit(text), codon))


def translate_protein(seq: Column) -> Column:
    """Protein of a coding sequence: stop is ``*``, a codon with any other letter is ``X``."""
    return F.array_join(F.transform(codons(F.upper(seq)), lambda c: amino_acid(c, "*", "X")), "")


def model_residues(seq: Column) -> Column:
    """Residues as a scorer sees them, one array element per codon: stop ``X``, unknown ``<unk>``."""
    return F.transform(codons(seq), lambda c: amino_acid(c, "X", UNKNOWN_RESIDUE))


def translate_model(seq: Column) -> Column:
    return F.array_join(model_residues(seq), "")


def strict_translation(seq: Column) -> Column:
    """Model residues, or NULL where a codon is unknown (the caller filters those rows)."""
    residues = model_residues(seq)
    return F.when(~F.array_contains(residues, UNKNOWN_RESIDUE), F.array_join(residues, ""))


def frame_sequence(seq: Column, frame: Column | int) -> Column:
    """The read from the first base of a reading frame on."""
    return F.substr(seq, F.lit(frame) + 1)


def three_frames(seq: Column) -> Column:
    """Array of (rf, seq), ready for ``inline``."""
    return F.array(*[F.struct(F.lit(rf).alias("rf"), frame_sequence(seq, rf).alias("frame_seq")) for rf in range(3)])


def equal_length_frame(seq: Column, frame: int) -> Column:
    """Frames cut to one common length: drop ``frame`` bases in front and ``3 - frame`` behind."""
    return F.substr(seq, F.lit(frame + 1), F.greatest(F.length(seq) - 3, F.lit(0)))


def pad_or_cut(seq: Column, max_codons: Column | int) -> Column:
    """Exactly ``3 * max_codons`` bases, filled up with N; the longest read of a group tells how many keep all of it."""
    max_codons = F.lit(max_codons) if isinstance(max_codons, int) else max_codons
    return F.rpad(seq, (3 * max_codons).cast("int"), F.lit("N"))


def codons_in_frame(length: Column, frame: Column | int) -> Column:
    """Whole codons that a read of this length holds in a frame."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.greatest(F.floor((length - frame) / 3), F.lit(0)).cast("int")


def _hits(letters: Column, base: str) -> Column:
    return F.transform(letters, lambda c: (c == base).cast("float"))


def one_hot(seq: Column) -> Column:
    """Four rows (A, C, G, T) of 0/1 floats, one per base; N and other letters are 0 in all rows."""
    letters = F.regexp_extract_all(seq, F.lit(r"[\s\S]"), F.lit(0))
    return let(letters, lambda bound: F.array(*[_hits(bound, base) for base in "ACGT"]))


def codon_features(seq: Column) -> Column:
    """Twelve 0/1 numbers per codon, nucleotide-major: A at 1, 2, 3, then C, G, T."""

    def features(codon: Column) -> Column:
        return F.array(
            *[(F.substring(codon, at, 1) == base).cast("float") for base in "ACGT" for at in (1, 2, 3)]
        )

    return F.transform(codons(seq), features)


def token_ids(residues: Column, vocabulary: dict[str, int], max_codons: Column | int) -> Column:
    """Struct (input_ids, attention_mask) with CLS and EOS around the residues, padded to ``max_codons + 2``.

    The vocabulary is the caller's and names at least ``<cls>``, ``<eos>``, ``<pad>`` and ``<unk>``.
    """
    max_codons = F.lit(max_codons) if isinstance(max_codons, int) else max_codons
    lookup = F.create_map(*[F.lit(part) for entry in vocabulary.items() for part in entry])
    unknown = F.lit(vocabulary["<unk>"])
    body = F.transform(F.slice(residues, F.lit(1), max_codons), lambda r: F.coalesce(F.try_element_at(lookup, r), unknown))
    ids = F.concat(F.array(F.lit(vocabulary["<cls>"])), body, F.array(F.lit(vocabulary["<eos>"])))

    def padded(bound: Column) -> Column:
        missing = max_codons + 2 - F.size(bound)
        return F.struct(
            F.concat(bound, F.array_repeat(F.lit(vocabulary["<pad>"]), missing)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(bound)), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
        )

    return let(ids, padded)


def mask_bases(seq: Column, key: Column, seed: int, per_million: int = 100) -> Column:
    """Turn each base into N with probability ``per_million / 1e6``, drawn from (seed, key, position from 0)."""
    letters = F.regexp_extract_all(seq, F.lit(r"[\s\S]"), F.lit(0))

    def masked(letter: Column, position: Column, drawn_from: Column) -> Column:
        return F.when(happens(per_million / 1e6, drawn_from, position), F.lit("N")).otherwise(letter)

    row = F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"))
    return let(row, lambda bound: F.array_join(F.transform(letters, lambda x, i: masked(x, i, bound)), ""))


def mask_residues(nt_seq: Column, residues: Column) -> Column:
    """Residue string with ``<unk>`` wherever the codon above it holds an N; ``residues`` is one letter per codon."""
    letters = F.regexp_extract_all(residues, F.lit(r"[\s\S]"), F.lit(0))
    return F.array_join(
        F.zip_with(codons(nt_seq), letters, lambda c, r: F.when(F.contains(c, F.lit("N")), F.lit(UNKNOWN_RESIDUE)).otherwise(r)),
        "",
    )


def frame_is_consistent(nt_seq: Column, residues: Column) -> Column:
    """A padded frame holds three bases per residue."""
    return F.length(nt_seq) == 3 * F.length(residues)


def count_bases(seq: Column, letters: str) -> Column:
    """How many of the (upper-case) letters a sequence holds."""
    return (F.length(seq) - F.length(F.translate(F.upper(seq), letters, ""))).cast("long")


def flip(length: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Coordinates on the other strand, 1-based inclusive."""
    return length - end + 1, length - start + 1


def reads_for_coverage(genome_length: Column, read_length: int, coverage: float = 1.0) -> Column:
    return F.ceil(genome_length * F.lit(coverage) / F.lit(read_length)).cast("long")
