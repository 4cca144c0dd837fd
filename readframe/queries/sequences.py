"""Sequence columns and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from readframe.functions import sequence as S
from readframe.functions.draws import threshold
from readframe.operators import genomes as G
from readframe.operators import windows as W
from readframe.plans.labelled_reads import without_n
from readframe.queries.registry import query
from readframe.session import measured
from readframe.sources import fasta

# The codon table as SQL: the three letters are base-4 digits.
_LETTERS = f"substr('{S.AMINO_ACIDS}', 16 * (instr('TCAG', x[1]) - 1) + 4 * (instr('TCAG', x[2]) - 1) + instr('TCAG', x[3]), 1)"
_KNOWN = "instr('TCAG', x[1]) > 0 and instr('TCAG', x[2]) > 0 and instr('TCAG', x[3]) > 0"


def _protein_sql(seq: str, stop: str = "*", unknown: str = "X") -> str:
    residue = f"replace({_LETTERS}, '*', '{stop}')"
    return f"array_to_string(MAP(regexp_extract_all({seq}, '...'), <x> case when {_KNOWN} then {residue} else '{unknown}' end), '')"


@query(
    """
    with t as (select input_order, name, translate(seq, 'U', 'T') as seq from {raw_reads})
    select input_order, name,
           case when regexp_matches(seq, '[^ACGTNRYSWKMBDHV]') then regexp_replace(seq, '[^ACGT]', 'N', 'g') else seq end as seq
    from t where length(seq) >= 30"""
)
def clean_reads(t):
    return fasta.clean(t("raw_reads"))


@query(
    """
    with t as (select input_order, name, translate(seq, 'U', 'T') as seq from {raw_reads})
    select input_order, name, cast(length(seq) as int) as length,
           case when length(seq) < 30 then 'too short' else 'non-standard letters' end as reason
    from t where length(seq) < 30 or regexp_matches(seq, '[^ACGTNRYSWKMBDHV]')"""
)
def rejected_reads(t):
    return fasta.rejects(t("raw_reads"))


@query(
    """
    select name, '+' as strand, seq from {reads}
    union all select name, '-', reverse(translate(seq, 'ACGTN', 'TGCAN')) from {reads}"""
)
def both_strands(t):
    return fasta.both_strands(t("reads").select("name", "seq"))


@query(
    f"""
    select name, cast(rf as int) as rf, {_protein_sql("substr(seq, cast(rf as int) + 1)")} as protein
    from {{reads}}, (select unnest([0, 1, 2]) as rf)"""
)
def translate_frames(t):
    frames = t("reads").select("name", F.inline(S.three_frames(F.col("seq"))))
    return frames.select("name", "rf", S.translate_protein(F.col("frame_seq")).alias("protein"))


@query(f"select name, {_protein_sql('seq', 'X', '<unk>')} as residues from {{reads}}")
def model_translation(t):
    return t("reads").select("name", S.translate_model(F.col("seq")).alias("residues"))


@query(f"select name, {_protein_sql('seq', 'X')} as residues from {{reads}} where length(seq) >= 0 and not regexp_matches(substr(seq, 1, length(seq) - length(seq) % 3), 'N')")
def strict_translation(t):
    strict = t("reads").select("name", S.strict_translation(F.col("seq")).alias("residues"))
    return strict.filter("residues is not null")


@query(
    """
    select name, substr(seq, 1, greatest(length(seq) - 3, 0)) as rf0, substr(seq, 2, greatest(length(seq) - 3, 0)) as rf1,
           substr(seq, 3, greatest(length(seq) - 3, 0)) as rf2
    from {reads}"""
)
def equal_length_frames(t):
    return t("reads").select("name", *[S.equal_length_frame(F.col("seq"), rf).alias(f"rf{rf}") for rf in range(3)])


def _longest(t):
    """Codons that hold the longest read of each genome."""
    return t("reads").groupBy("accession").agg(F.max(F.ceil(F.length("seq") / 3)).cast("int").alias("codons"))


@query(
    """
    with longest as (select accession, cast(ceil(max(length(seq)) / 3) as int) as codons from {reads} group by accession)
    select name, rpad(seq, 3 * codons, 'N') as padded from {reads} join longest using (accession)"""
)
def padded_reads(t):
    """Reads filled up to the longest of their genome."""
    return t("reads").join(_longest(t), "accession").select("name", S.pad_or_cut(F.col("seq"), F.col("codons")).alias("padded"))


@query(
    """
    select name, array_to_string(MAP(string_split(seq, ''), <x> case when x = 'A' then '1' else '0' end), '') as a,
           array_to_string(MAP(string_split(seq, ''), <x> case when x = 'T' then '1' else '0' end), '') as t
    from {reads} where seq <> ''"""
)
def one_hot_rows(t):
    rows = S.one_hot(F.col("seq"))
    text = lambda i: F.array_join(F.transform(F.get(rows, F.lit(i)), lambda v: v.cast("int").cast("string")), "")
    return t("reads").filter("seq != ''").select("name", text(0).alias("a"), text(3).alias("t"))


@query(
    """
    with bases as (
      select name, unnest(string_split(seq, '')) as base, generate_subscripts(string_split(seq, ''), 1) - 1 as i, length(seq) as n
      from {reads} where seq <> '')
    select name, cast(3 * (instr('ACGT', base) - 1) + i % 3 as int) as feature, count(*) as n_codons
    from bases where instr('ACGT', base) > 0 and i < n - n % 3
    group by all"""
)
def codon_feature_counts(t):
    """Codons of each read that have each of the twelve features."""
    codons = t("reads").select("name", F.explode(S.codon_features(F.col("seq"))).alias("f"))
    hits = codons.select("name", F.posexplode("f").alias("feature", "v")).filter("v = 1")
    return hits.groupBy("name", "feature").agg(F.count("*").alias("n_codons"))


VOCABULARY = {"<cls>": 0, "<pad>": 1, "<eos>": 2, "<unk>": 3} | {r: 4 + i for i, r in enumerate("LAGVSERTIDPKQNFYMHWCX")}


@query(
    f"""
    with t as (
      select name, accession, regexp_extract_all({_protein_sql("seq", "X", "Z")}, '.') as residues from {{reads}}),
    longest as (select accession, cast(ceil(max(length(seq)) / 3) as int) as codons from {{reads}} group by accession)
    select name, concat(array_to_string(list_concat(['0'], list_transform(residues, lambda x: case when x = 'Z' then '3' else cast(3 + instr('LAGVSERTIDPKQNFYMHWCX', x) as varchar) end), ['2']), ','),
                        repeat(',1', cast(codons - len(residues) as int))) as ids,
           cast(len(residues) + 2 as int) as n_attended
    from t join longest using (accession)"""
)
def token_ids(t):
    """Token ids filled up to the longest read of each genome."""
    tokens = S.token_ids(S.model_residues(F.col("seq")), VOCABULARY, F.col("codons"))
    rows = t("reads").join(measured(_longest(t)), "accession").select("name", tokens.alias("k"))
    # The mask holds ones and zeros.
    attended = F.size(F.array_remove("k.attention_mask", 0))
    return rows.select("name", F.array_join(F.col("k.input_ids").cast("array<string>"), ",").alias("ids"), attended.alias("n_attended"))


@query(
    """
    select name, cast(rf as int) as rf, cast(greatest((length(seq) - rf) // 3, 0) as int) as n_codons
    from {reads}, (select unnest([0, 1, 2]) as rf)"""
)
def frame_codon_counts(t):
    frames = t("reads").select("name", F.length("seq").alias("n"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rf"))
    return frames.select("name", "rf", S.codons_in_frame(F.col("n"), F.col("rf")).alias("n_codons"))


@query(
    f"""
    with t as (select name, regexp_extract_all(seq, '...') as codons, regexp_extract_all({_protein_sql("seq", "X")}, '.') as residues from {{reads}})
    select name, array_to_string(list_transform(range(1, len(codons) + 1), lambda i: case when contains(codons[i], 'N') then '<unk>' else residues[i] end), '') as masked
    from t"""
)
def residue_masking(t):
    protein = F.translate(S.translate_protein(F.col("seq")), "*", "X")
    return t("reads").select("name", S.mask_residues(F.col("seq"), protein).alias("masked"))


_MASKED = f"""
    masked_reads as (
      select name, seq, array_to_string(list_transform(string_split(seq, ''), lambda x, i: case when substr(md5(concat_ws(':', 42, name, i - 1)), 1, 8) < '{threshold(0.01)}' then 'N' else x end), '') as masked
      from {{reads}})"""


@query(f"with {_MASKED} select name, masked from masked_reads")
def base_masking(t):
    """Reads with one base in a hundred masked by hash draw."""
    return t("reads").select("name", S.mask_bases(F.col("seq"), F.col("name"), seed=42, per_million=10_000).alias("masked"))


@query(
    """
    select accession, cast(sum(length(seq)) as bigint) as genome_length, cast(floor(sum(length(seq)) / 1000) as int) as genome_length_kb,
           round(100.0 * sum(length(seq) - length(translate(seq, 'CG', ''))) / sum(length(seq) - length(translate(seq, 'ACGT', ''))), 1) as gc_content
    from {reads} group by accession"""
)
def genome_composition(t):
    return G.composition(t("reads"))


@query(
    """
    select accession, cast(sum(length(seq)) as bigint) as genome_length, cast(ceil(sum(length(seq)) * 1.0 / 300) as bigint) as n_reads
    from {reads} group by accession"""
)
def reads_for_coverage(t):
    return G.reads_to_draw(t("reads"), 300)


@query("select name, cast(length(seq) as int) as length, length(seq) > 300 as is_long from {reads}")
def routed_reads(t):
    return fasta.route(t("reads")).select("name", F.length("seq").alias("length"), "is_long")


@query("select name, seq from {reads} where not contains(seq, 'N')")
def reads_without_n(t):
    return without_n(t("reads"), "seq").select("name", "seq")


_STARTS = """case when length(seq) <= 300 then [0] else
      list_distinct(list_concat(range(0, length(seq) - 299, 150), [((length(seq) - 300) // 3 * 3)])) end"""


@query(
    f"""
    with w as (select name, seq, unnest({_STARTS}) as window_start from {{reads}})
    select name, cast(window_start as int) as window_start, substr(seq, cast(window_start as int) + 1, 300) as window_seq from w"""
)
def read_windows(t):
    """Windows of 100 codons every 50 codons; lengths of 300 and strides of 150 never give a tail below the last start."""
    return W.read_windows(t("reads").select("name", "seq")).select("name", "window_start", "window_seq")


@query(
    """
    with cells as (
      select read_name, window_start // 3 + (k - 1) // 4 as codon, (k - 1) % 4 as label, cast(embedding[k] as double) as v
      from {window_scores}, (select unnest(range(1, 65)) as k))
    select read_name, cast(codon as int) as codon, cast(label as int) as label, round(avg(v), 6) as score
    from cells where codon < 40 group by read_name, codon, label"""
)
def merged_window_scores(t):
    merged = W.merge_window_scores(_scored(t), 4)
    cells = merged.select("read_name", "codon", F.posexplode("scores").alias("label", "score"))
    return cells.withColumn("score", F.round("score", 6))


def _scored(t):
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    return t("window_scores").select("read_name", "strand", "length", "window_start", matrix.alias("scores"))
