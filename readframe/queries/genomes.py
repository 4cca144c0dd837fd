"""Genome tables, taxonomy, data sets and whole table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from readframe.functions import labels as L
from readframe.functions import sequence as S
from readframe.functions.draws import DRAW_BITS, threshold
from readframe.operators import containment as K
from readframe.operators import datasets as DS
from readframe.operators import genomes as G
from readframe.operators import intervals as I
from readframe.operators import rejects as J
from readframe.operators import stats as T
from readframe.operators import taxonomy as X
from readframe.plans import cds_records as CR
from readframe.plans import labelled_reads as LR
from readframe.queries.labels import _CHAINED_TRUTH, _CLASSES, _LABEL_SCHEME
from readframe.queries.registry import draw_sql, query
from readframe.queries.sequences import _KNOWN, _LETTERS, _protein_sql
from readframe.sources import sinks

# ---- proteins and references ----

_PEPTIDES = f"""
    proteins as (select distinct accession, protein from (select accession, unnest(string_split({_protein_sql("seq")}, '*')) as protein from {{reads}}) where protein <> ''),
    fragments as (select distinct accession, fragment from (select accession, unnest(string_split({_protein_sql("substr(seq, 2)")}, '*')) as fragment from {{reads}}) where fragment <> '')"""


def _peptides(t, frame: int, name: str):
    protein = S.translate_protein(S.frame_sequence(F.col("seq"), frame))
    return t("reads").select("accession", F.explode(F.split(protein, "\\*")).alias(name)).filter(F.col(name) != "")


@query(
    f"""
    with {_PEPTIDES}
    select accession, fragment from fragments f
    where exists (select 1 from proteins p where p.accession = f.accession and contains(p.protein, translate(f.fragment, 'X', 'W')))"""
)
def fragments_in_proteome(t):
    """Peptides of frame 1 that occur in a frame-0 peptide of the same genome."""
    return K.contained_fragments(_peptides(t, 1, "fragment"), _peptides(t, 0, "protein"))


@query(
    """
    with s as (select name, seq, unnest(range(1, length(seq) + 1, 35)) as start from {reads}),
    r as (select name, start, substr(seq, start, 40) as part from s),
    changed as (select name, start, case when start % 3 = 0 then concat('N', substr(part, 2)) else part end as restored, part from r)
    select name as read_name, cast(start as bigint) as start, restored = part as is_restored from changed"""
)
def reference_match(t):
    """Pieces of every sequence held against the sequence in chunks; every third piece has a changed first base."""
    seqs = t("reads").filter("seq != ''").select("name", "seq")
    starts = seqs.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("seq"), F.lit(35))))
    part = F.substr("seq", F.col("start"), F.lit(40))
    pieces = starts.select(
        F.col("name").alias("assembly_id"), F.lit("+").alias("strand"), F.col("start").cast("long"),
        F.when(F.col("start") % 3 == 0, F.concat(F.lit("N"), F.substr(part, F.lit(2)))).otherwise(part).alias("restored"),
    )
    chunks = I.chunk_sequences(seqs.select(F.col("name").alias("assembly_id"), F.lit("+").alias("strand"), "seq"), overlap=40, width=16)
    matched = I.matches_reference(pieces, chunks, width=16)
    return matched.select(F.col("assembly_id").alias("read_name"), "start", "is_restored")


# ---- the labelled-read job: every text is a genome with reads, annotations and proteins ----

_LENGTH = 90


def _genome_inputs(t):
    texts = t("reads").select(F.col("name").alias("assembly_id"), "accession", "seq")
    # A read needs a text of its length; one with a deletion a further base, without which it has none.
    starts = F.sequence(F.lit(1), F.length("seq") - (_LENGTH - 1), F.lit(31))
    placed = texts.filter(F.length("seq") >= _LENGTH).withColumn("start_coordinate", F.explode(starts))
    kind = F.pmod(F.col("start_coordinate"), F.lit(4))
    kind = F.when((kind == 2) & (F.col("start_coordinate") + _LENGTH > F.length("seq")), 0).otherwise(kind)
    plain = F.substr("seq", F.col("start_coordinate"), F.lit(_LENGTH))
    longer = F.substr("seq", F.col("start_coordinate"), F.lit(_LENGTH + 1))
    first = F.substr(plain, F.lit(1), F.lit(30))
    alignments = placed.select(
        "assembly_id", "accession", F.lit("+").alias("strand"), "start_coordinate",
        F.concat_ws("_", "assembly_id", F.col("start_coordinate").cast("string")).alias("read_id"),
        F.when(kind == 1, F.concat(first, F.lit("A"), F.substr(plain, F.lit(31), F.lit(_LENGTH - 31))))
        .when(kind == 2, F.concat(first, F.substr(longer, F.lit(32))))
        .when(kind == 3, F.concat(F.lit("C"), F.substr(plain, F.lit(2))))
        .otherwise(plain).alias("read"),
        F.when(kind == 1, f"30M1I{_LENGTH - 31}M").when(kind == 2, f"30M1D{_LENGTH - 30}M").otherwise(f"{_LENGTH}M").alias("cigar"),
        F.when(kind == 1, str(_LENGTH - 1)).when(kind == 2, F.concat(F.lit("30^"), F.substr(longer, F.lit(31), F.lit(1)), F.lit(str(_LENGTH - 30))))
        .when(kind == 3, F.concat(F.lit("0"), F.substr(plain, F.lit(1), F.lit(1)), F.lit(str(_LENGTH - 1))))
        .otherwise(str(_LENGTH)).alias("md"),
    )
    genes = F.sequence(F.lit(10), F.greatest(F.length("seq"), F.lit(10)), F.lit(217))
    end = (F.col("cds_start") + 3 * (25 + F.pmod("cds_start", F.lit(30))) - 1).cast("long")
    annotations = texts.withColumn("cds_start", F.explode(genes)).filter(end <= F.length("seq")).select(
        "assembly_id", "accession", F.lit("+").alias("strand"), F.col("cds_start").cast("long"), end.alias("cds_end"),
        (F.pmod("cds_start", F.lit(11)) != 0).alias("certain"), "seq",
    )
    assemblies = texts.select("assembly_id", F.lit("+").alias("strand"), "seq")
    # The proteome lacks every seventh protein, so that some fragments are in none.
    body = S.translate_model(F.substr("seq", F.col("cds_start").cast("int"), (F.col("cds_end") - F.col("cds_start") + 1).cast("int")))
    bodies = annotations.filter("cds_start % 7 != 0").select("accession", F.translate(body, "X", "W").alias("protein"))
    return alignments, I.check_annotations(annotations.drop("seq")), assemblies, bodies


# The job in plain SQL.  A read is cut at every 31st base; its kind tells its error: 1 an inserted A behind the 30th base,
# 2 a deletion there, 3 a C for the first base.
_JOB = f"""
    genes as (
      select name as assembly_id, accession, seq, cds_start, cds_start + 3 * (25 + cds_start % 30) - 1 as cds_end, cds_start % 11 <> 0 as certain
      from (select name, accession, seq, unnest(range(10, length(seq) + 1, 217)) as cds_start from {{reads}}) g where cds_start + 3 * (25 + cds_start % 30) - 1 <= length(seq)),
    cut as (
      select name as assembly_id, accession, seq, start_at, concat(name, '_', start_at) as read_id, case when start_at % 4 = 2 and start_at + {_LENGTH} > length(seq) then 0 else start_at % 4 end as kind
      from (select name, accession, seq, unnest(range(1, length(seq) - {_LENGTH - 2}, 31)) as start_at from {{reads}} where length(seq) >= {_LENGTH}) r),
    aligned as (
      select *, case kind when 1 then concat(substr(seq, start_at, 30), 'A', substr(seq, start_at + 30, {_LENGTH - 31}))
                          when 2 then concat(substr(seq, start_at, 30), substr(seq, start_at + 31, {_LENGTH - 30}))
                          when 3 then concat('C', substr(seq, start_at + 1, {_LENGTH - 1})) else substr(seq, start_at, {_LENGTH}) end as read,
             case kind when 1 then '30M1I{_LENGTH - 31}M' when 2 then '30M1D{_LENGTH - 30}M' else '{_LENGTH}M' end as cigar,
             case kind when 1 then '{_LENGTH - 1}' when 2 then concat('30^', substr(seq, start_at + 30, 1), '{_LENGTH - 30}')
                       when 3 then concat('0', substr(seq, start_at, 1), '{_LENGTH - 1}') else '{_LENGTH}' end as md
      from cut),
    usable as (
      select a.* exclude (seq), case when kind = 3 and substr(seq, start_at, 1) <> 'N' then substr(seq, start_at, {_LENGTH}) else read end as restored,
             kind <> 3 or substr(seq, start_at, 1) <> 'N' as is_same
      from aligned a
      where not contains(read, 'N') and not exists (
        select 1 from genes u where not u.certain and u.assembly_id = a.assembly_id and a.start_at between u.cds_start - {_LENGTH} and u.cds_end)),
    bases as (
      select read_id, rf, j, start_at + rf + j - moved as base, cds_start, cds_end
      from (
        select *, case when kind = 1 and j > 30 - rf then 1 when kind = 2 and j >= 30 - rf then -1 else 0 end as moved
        from (
          select read_id, kind, start_at, rf, cds_start, cds_end, unnest(range(0, ({_LENGTH} - rf) // 3 * 3)) as j
          from usable a join genes c on a.assembly_id = c.assembly_id and c.certain and start_at <= cds_end and cds_start < start_at + {_LENGTH}, (select unnest([0, 1, 2]) as rf) f) x) y
      where not (kind = 1 and j = 30 - rf) and (cds_start + moved - start_at - rf) % 3 = 0),
    nt as (
      select read_id, rf, j, coalesce(arg_max(case when base < cds_start + 3 then 2 else 3 end, cds_start) filter (base < cds_start + 3 or base > cds_end - 3), 1) as label
      from bases where base between cds_start and cds_end group by read_id, rf, j),
    codons as (select read_id, rf, j // 3 as k, arg_min(label, j) as label from nt group by read_id, rf, j // 3 having count(*) = 3),
    frames as (
      select u.read_id, f.rf, list_transform(range(0, ({_LENGTH} - f.rf) // 3), lambda k: cast(coalesce(m[k], 0) as tinyint)) as labels
      from usable u cross join (select unnest([0, 1, 2]) as rf) f
      left join (select read_id, rf, map(list(k order by k), list(label order by k)) as m from codons group by read_id, rf) c on c.read_id = u.read_id and c.rf = f.rf),
    job_labels as (
      select read_id as name, {_LENGTH} as length, any_value(labels) filter (rf = 0) as rf0_labels, any_value(labels) filter (rf = 1) as rf1_labels, any_value(labels) filter (rf = 2) as rf2_labels
      from frames group by read_id),
    {_CHAINED_TRUTH.replace("{labelled}", "job_labels")},
    linked as (select *, lead(start) over c as next_start, (lead(rf) over c - rf + 3) % 3 as step from walk window c as (partition by name, chain order by k)),
    coords as (
      select s.name, list(concat('[', start, ', ', "end", ', ', chr(39), s.rf, chr(39), ']') order by k) as spans, list(chain order by k) as chains, bool_or("end" - start < 3) as has_short,
             bool_or(next_start is not null and kind in (1, 2) and 31 between "end" and next_start and step <> kind) as has_wrong_step
      from linked s join usable u on s.name = u.read_id group by s.name),
    coded as (select name as read_id, rf, i, i - row_number() over (partition by name, rf order by i) as run from cells where label = 1),
    residues as (select c.read_id, accession, rf, run, i, substr(restored, cast(3 * i + rf + 1 as int), 3) as x from coded c join usable u on c.read_id = u.read_id),
    fragments as (
      select read_id, accession, string_agg(case when {_KNOWN} then replace({_LETTERS}, '*', 'X') else '<unk>' end, '' order by i) as fragment
      from residues group by read_id, accession, rf, run),
    proteome as (
      select distinct accession, replace({_protein_sql("substr(seq, cast(cds_start as int), cast(cds_end - cds_start + 1 as int))", "W", "<unk>")}, 'X', 'W') as protein from genes where cds_start % 7 <> 0),
    known as (
      select accession, fragment from (select distinct accession, fragment from fragments) f
      where exists (select 1 from proteome p where p.accession = f.accession and contains(p.protein, replace(fragment, 'X', 'W')))),
    unknown as (select distinct read_id from fragments f where not exists (select 1 from known k where k.accession = f.accession and k.fragment = f.fragment)),
    checked as (
      select u.*, l.rf0_labels, l.rf1_labels, l.rf2_labels, coalesce(spans, []) as spans, coalesce(chains, []) as chains,
             case when not is_same then 'not the reference' when has_short then 'short CDS' when has_wrong_step then 'indel against its frames' when x.read_id is not null then 'fragment in no protein' end as reason,
             is_same and not coalesce(has_short, false) and not coalesce(has_wrong_step, false) and x.read_id is null as kept
      from usable u join job_labels l on u.read_id = l.name left join coords c on u.read_id = c.name left join unknown x on u.read_id = x.read_id)"""


def _list_sql(items: str) -> str:
    return f"concat('[', array_to_string({items}, ','), ']')"


_ROWS = f"""
    labelled_rows as (
      select read_id as read_name, read, concat('[', array_to_string(spans, ', '), ']') as cds_coords,
             list_transform(list_sort(list_distinct(chains)), lambda c: list_filter(range(0, len(chains)), lambda i: chains[i + 1] = c)) as lists,
             cast(start_at as int) as start_coord, assembly_id, cigar as "CIGAR", md as "MD", case kind when 1 then '31I' when 2 then '31D' end as indel_positions, accession, kind, chains,
             {_protein_sql("read", "X", "<unk>")} as rf0_seq, rf0_labels, {_protein_sql("substr(read, 2)", "X", "<unk>")} as rf1_seq, rf1_labels, {_protein_sql("substr(read, 3)", "X", "<unk>")} as rf2_seq, rf2_labels,
             '+' as strand
      from checked where kept)"""


@query(
    f"""
    with {_JOB}, {_ROWS}
    select read_name, read, cds_coords, {_list_sql(f"list_transform(lists, lambda c: {_list_sql('c')})")} as cds_fragments_connection, start_coord, assembly_id, "CIGAR", "MD", indel_positions, accession,
           rf0_seq, {_list_sql("rf0_labels")} as rf0_labels, rf1_seq, {_list_sql("rf1_labels")} as rf1_labels, rf2_seq, {_list_sql("rf2_labels")} as rf2_labels, strand
    from labelled_rows""",
    recursive=True,
)
def labelled_reads(t):
    """Reads cut from every text, restored, labelled, checked and written in the labelled-read schema, lists as text."""
    return sinks.as_csv_text(LR.labelled_rows(LR.check_reads(*_genome_inputs(t), read_length=_LENGTH)))


@query(
    f"""
    with {_JOB}
    select accession, count(*) filter (kept) as n_correct, count(*) filter (not kept) as n_wrong, round(count(*) filter (kept) / count(*) * 100, 2) as percent_correct from checked group by accession""",
    recursive=True,
)
def read_keep_rate(t):
    """Kept and rejected reads per genome of the labelled-read job."""
    return DS.keep_rate(LR.check_reads(*_genome_inputs(t), read_length=_LENGTH))


@query(f"with {_JOB} select accession, reason, count(*) as n from checked where not kept group by all", recursive=True)
def rejected_labelled_reads(t):
    """Reads that the labelled-read job rejects, by genome and reason."""
    rejected = J.rejected_rows(LR.check_reads(*_genome_inputs(t), read_length=_LENGTH))
    return rejected.groupBy("accession", "reason").agg(F.count("*").alias("n"))


def _bordered(labels: str) -> str:
    """Labels of a read with an indel: the first 1 after a 0 becomes 4, another 1 before a 0 becomes 5."""
    marked = f"case when x <> 1 then x when i > 1 and {labels}[i - 1] = 0 then 4 when i < len({labels}) and {labels}[i + 1] = 0 then 5 else x end"
    return f"case when kind in (1, 2) then list_transform({labels}, lambda x, i: {marked}) else {labels} end"


def _hidden(rf: int) -> str:
    codons = f"regexp_extract_all(rf{rf}_nt, '...')"
    return f"array_to_string(list_transform(string_split(substr(rf{rf}_seq, 1, n), ''), lambda x, i: case when contains({codons}[i], 'N') then '<unk>' else x end), '')"


_RF = range(3)
_TRAINING = f"""
    described as (
      select r.*, len(rf1_labels) as n, {", ".join(f"{_bordered(f'rf{rf}_labels')} as l{rf}" for rf in _RF)},
             {" or ".join(f"list_contains(rf{rf}_labels, 2)" for rf in _RF)} as has_start, {" or ".join(f"list_contains(rf{rf}_labels, 3)" for rf in _RF)} as has_stop,
             {" or ".join(f"(list_contains(rf{rf}_labels, 0) and list_contains(rf{rf}_labels, 1))" for rf in _RF)} as is_mixed,
             array_to_string(list_transform(string_split(read, ''), lambda x, i: case when substr(md5(concat_ws(':', 42, read_name, i - 1)), 1, 8) < '{threshold(1e-4)}' then 'N' else x end), '') as masked
      from labelled_rows r),
    framed as (select *, {", ".join(f"substr(masked, {rf + 1}, {_LENGTH} - 3) as rf{rf}_nt" for rf in _RF)} from described)"""
_CLASS_OF = f"list_position({[100 * a + 10 * b + c for a, b, c in _LABEL_SCHEME]}, 100 * cast(l0[i] as int) + 10 * cast(l1[i] as int) + l2[i])"


@query(
    f"""
    with {_JOB}, {_ROWS}, {_TRAINING}
    select accession, read_name, {", ".join(f"rf{rf}_nt as rf{rf}_seq_nt, {_hidden(rf)} as rf{rf}_seq_aa, {_list_sql(f'l{rf}[1:n]')} as rf{rf}_labels" for rf in _RF)},
           {_list_sql(f"list_transform(range(1, n + 1), lambda i: coalesce(cast({_CLASS_OF} - 1 as varchar), 'null'))")} as label_encodings,
           case when kind in (1, 2) and is_mixed then 'transition_indel' when has_start and has_stop then 'transition_start_stop' when has_start then 'transition_start' when has_stop then 'transition_stop'
                when len(chains) = 0 then 'non-coding' when "MD" <> '{_LENGTH}' then 'coding_with_substitutions' else 'coding' end as seq_desc, true as consistent
    from framed""",
    recursive=True,
)
def model_dataset(t):
    """Training rows with masked bases, class ids and sequence types from labelled reads, lists as text."""
    reads = LR.labelled_rows(LR.check_reads(*_genome_inputs(t), read_length=_LENGTH))
    rows = DS.model_dataset(reads, _LABEL_SCHEME, _LENGTH, training=True)
    return rows.withColumns({c: F.to_json(c) for c, kind in rows.dtypes if kind.startswith("array")})


# Every 42 bases of a read hold four single CDSs, on both strands, and one of two fragments.
_ORFS = f"""
    blocks as (select input_order, name, seq, length(seq) as n, unnest(range(0, (length(seq) + 41) // 42)) as b from {{reads}}),
    rows as (
      select input_order * 1000000 + b * 10 + k as first_line, concat(name, '_', b, '_', k) as cds_id,
             case when k % 2 = 0 then substr(seq, 42 * b + 4 * k + 1, 30) else reverse(translate(substr(seq, 42 * b + 4 * k + 1, 30), 'ACGTN', 'TGCAN')) end as cds_seq
      from blocks, (select unnest([0, 1, 2, 3]) as k) where 42 * b + 4 * k < n),
    chains as (
      select input_order * 1000000 + b * 10 + 5 as first_line, concat(name, '_', b, '_group') as cds_id,
             case when b % 2 = 0 then concat(substr(seq, 42 * b + 1, 12), substr(seq, 42 * b + 14, 15)) else concat(substr(seq, 42 * b + 1, 12), 'NNN', substr(seq, 42 * b + 15, 15)) end as cds_seq
      from blocks where 42 * b + 29 <= n),
    records as (select * from rows union all select * from chains)"""


@query(f"with {_ORFS} select first_line, cds_id, cds_seq, {_protein_sql('cds_seq')} as protein from records")
def cds_records(t):
    """CDS records of places all along each read, on both strands, and of two-fragment chains."""
    # Places need a read's length only; its text would be copied to every one of them.
    last = F.floor((F.col("length") - 1) / 42)
    lengths = t("reads").filter("seq != ''").select("input_order", "name", F.length("seq").alias("length"))
    reads = lengths.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at, line = F.col("b") * 42, F.col("input_order") * 1_000_000 + F.col("b") * 10
    named = (F.col("name"), F.lit("_"), F.col("b").cast("string"), F.lit("_"))
    none = F.lit(None).cast("string")
    places = reads.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)]))).filter(at + F.col("k") * 4 < F.col("length"))
    singles = places.select(
        (line + F.col("k")).alias("line"), F.col("name").alias("seqid"), (at + F.col("k") * 4 + 1).cast("int").alias("start"),
        F.least(at + F.col("k") * 4 + 30, F.col("length")).cast("int").alias("end"), F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("strand"), none.alias("phase"),
        F.concat(F.lit("ID="), *named, F.col("k").cast("string"), F.lit(";start=internal_region")).alias("attributes"),
    )
    even = F.col("b") % 2 == 0
    chained = reads.filter(at + 29 <= F.col("length")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (line + 5 + F.col("k")).alias("line"), F.col("name").alias("seqid"),
        (at + F.when(F.col("k") == 0, 1).when(even, 14).otherwise(15)).cast("int").alias("start"),
        (at + F.when(F.col("k") == 0, 12).when(even, 28).otherwise(29)).cast("int").alias("end"),
        F.lit("+").alias("strand"), F.when(F.col("k") == 0, "0").when(even, "1").otherwise("2").alias("phase"),
        F.concat(F.lit("ID="), *named, F.lit("group;group_id=group_"), F.col("b").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(";indel_type="), F.when(even, "insertion").otherwise("deletion")).alias("attributes"),
    )
    gff = singles.unionByName(chained).withColumn("type", F.lit("CDS"))
    return CR.cds_records(gff, t("reads").select("name", "seq"))


# ---- genome tables ----


def _gene_rows(t):
    return t("annotations").select(
        F.concat(F.lit("g"), F.substr("assembly_id", F.lit(2))).alias("accession"), F.col("strand").alias("landmark"), "cds_start", "cds_end"
    )


@query(
    """
    with rows as (select concat('g', substr(assembly_id, 2)) as accession, strand as landmark, cds_start, cds_end from {annotations}),
    ordered as (select *, max(cds_end) over (partition by accession, landmark order by cds_start, cds_end rows between unbounded preceding and 1 preceding) as reach from rows),
    islands as (select *, sum(case when reach is null or cds_start > reach then 1 else 0 end) over (partition by accession, landmark order by cds_start, cds_end rows unbounded preceding) as island from ordered),
    merged as (select accession, max(cds_end) - min(cds_start) + 1 as len from islands group by accession, landmark, island),
    covered as (select accession, cast(sum(len) as bigint) as coding_length from merged group by all),
    genes as (select accession, cast(count(*) as int) as protein_coding_genes, cast(trunc(median(cds_end - cds_start + 1)) as int) as cds_median_length from rows group by all)
    select g.*, coding_length from genes g join covered c on g.accession = c.accession"""
)
def gene_numbers(t):
    return G.gene_numbers(_gene_rows(t))


@query(
    """
    with numbers as (
      select accession, cast(floor(sum(length(seq)) / 1000) as int) as genome_length_kb,
             round(100.0 * sum(length(seq) - length(translate(seq, 'CG', ''))) / sum(length(seq) - length(translate(seq, 'ACGT', ''))), 1) as gc_content, sum(length(seq)) as n
      from {reads} group by accession),
    cds as (select concat('g', doc_id % 20) as accession, concat('d', doc_id) as landmark, 1 as cds_start, (n_chars + 1) // 2 as cds_end from {documents}),
    genes as (select accession, cast(count(*) as int) as protein_coding_genes, cast(trunc(median(cds_end - cds_start + 1)) as int) as cds_median_length, sum(cds_end - cds_start + 1) as covered from cds group by all)
    select i.accession, strain, species, genus, family, "order", class, phylum, domain, n.genome_length_kb, n.gc_content, g.protein_coding_genes, g.cds_median_length, round(covered / n * 100, 2) as coding_percentage
    from {genomes} i join numbers n on i.accession = n.accession join genes g on g.accession = i.accession"""
)
def genome_table(t):
    """Genome rows from ranks, sequences and annotations; each text is a sequence with one gene over its first half."""
    cds = t("documents").select(
        F.concat(F.lit("g"), F.col("doc_id") % 20).alias("accession"), F.concat(F.lit("d"), "doc_id").alias("landmark"),
        F.lit(1).cast("long").alias("cds_start"), F.expr("(n_chars + 1) div 2").alias("cds_end"),
    )
    ranks = t("genomes").select("accession", *X.RANKS)
    return G.genome_table(ranks, t("reads").select("accession", "seq"), cds)


_STATS = ("gc_content", "genome_length_kb", "coding_percentage", "protein_coding_genes")


@query(
    """
    with stacked as (
      select partition, unnest([{'s': 'gc_content', 'v': gc_content}, {'s': 'genome_length_kb', 'v': cast(genome_length_kb as double)},
                                {'s': 'coding_percentage', 'v': coding_percentage}, {'s': 'protein_coding_genes', 'v': cast(protein_coding_genes as double)}]) as x from {genomes})
    select partition, x.s as statistic, count(x.v) as n, round(avg(x.v), 6) as mean, round(stddev_samp(x.v), 6) as std, min(x.v) as minimum, max(x.v) as maximum,
           round(quantile_cont(x.v, 0.25), 6) as q1, round(median(x.v), 6) as median, round(quantile_cont(x.v, 0.75), 6) as q3
    from stacked group by partition, x.s"""
)
def genome_statistics(t):
    out = T.describe(t("genomes"), ["partition"], list(_STATS))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "median", "q3")})


_FAMILY_COLUMNS = ", ".join(
    f"round(median({c}), 6) as {c}_median, min({c}) as {c}_min, max({c}) as {c}_max"
    for c in ("genome_length_kb", "protein_coding_genes", "coding_percentage", "gc_content")
)


@query(f"select family, count(*) as n_genomes, {_FAMILY_COLUMNS} from {{genomes}} group by family")
def family_table(t):
    table = X.family_table(t("genomes"))
    return table.withColumns({c: F.round(c, 6) for c in table.columns if c.endswith("_median")})


@query(
    """
    select accession, coalesce(strain, species) as organism, family, domain from {genomes}
    where accession in (select concat('g', o_custkey) from {orders} where o_totalprice > 400000)"""
)
def reference_organisms(t):
    listed = t("orders").filter("o_totalprice > 400000").select(F.concat(F.lit("g"), "o_custkey").alias("accession"))
    return X.reference_organisms(t("genomes"), listed).select("accession", "organism", "family", "domain")


# Taxonomy: customers are strains below segments, nations, regions, two domains and a root.
_TAXONOMY = {
    "nodes": """
        select concat('c', c_custkey) as tax_id, concat('s', c_nationkey, c_mktsegment) as parent_id, 'species' as rank, c_name as name from {customer}
        union select concat('s', c_nationkey, c_mktsegment), concat('n', c_nationkey), 'genus', concat(c_mktsegment, ' of ', c_nationkey) from {customer}
        union select concat('n', n_nationkey), concat('r', n_regionkey), 'family', n_name from {nation}
        union select concat('r', r_regionkey), case when r_regionkey < 3 then '2' when r_regionkey = 3 then '2157' else '1' end, 'phylum', r_name from {region}
        union select case when r_regionkey = 0 then '2' else '2157' end, '1', 'domain', case when r_regionkey = 0 then 'Bacteria' else 'Archaea' end from {region} where r_regionkey < 2
        union select '1', '1', 'no rank', 'root' from {region} where r_regionkey = 0""",
}


def _taxonomy(t):
    spark_sql = _TAXONOMY["nodes"]
    spark = t("region").sparkSession
    nodes = spark.sql(spark_sql, customer=t("customer"), nation=t("nation"), region=t("region"))
    taxa = t("genomes").select("accession", F.concat(F.lit("c"), F.substr("accession", F.lit(2))).alias("tax_id"))
    return taxa, nodes.select("tax_id", "parent_id", "rank"), nodes.select("tax_id", "name")


_LINEAGE = f"""
    nodes as ({_TAXONOMY["nodes"]}),
    walk(accession, depth, tax_id, parent_id, rank, name) as (
      select g.accession, 0, n.tax_id, n.parent_id, n.rank, n.name from {{genomes}} g join nodes n on n.tax_id = concat('c', substr(g.accession, 2))
      union all
      select w.accession, w.depth + 1, n.tax_id, n.parent_id, n.rank, n.name from walk w join nodes n on n.tax_id = w.parent_id where w.tax_id not in ('2', '2157', '1')),
    reached as (select * from walk where accession in (select accession from walk where tax_id in ('2', '2157')))"""


@query(f"with {_LINEAGE} select accession, cast(depth as int) as depth, tax_id, rank, name from reached", recursive=True)
def lineages(t):
    return X.lineages(*_taxonomy(t))


_RANK_COLUMNS = ", ".join(f"max(name) filter (where rank = '{r}') as \"{r}\"" for r in X.RANKS)


@query(f"with {_LINEAGE} select accession, {_RANK_COLUMNS} from reached group by accession", recursive=True)
def lineage_ranks(t):
    """Eight rank columns per genome; ranks the lineage does not have are NULL."""
    return X.rank_columns(X.lineages(*_taxonomy(t)))


_CLEAN = "translate({0}, '(),:; ''\"', '[]____')"


@query(
    f"""
    with leaves as (select domain, family, genus, accession from {{genomes}}),
    nodes as (
      select distinct '' as parent, domain as name, domain as path, 0 as leaf from leaves
      union select distinct domain, family, concat(domain, chr(1), family), 0 from leaves
      union select distinct concat(domain, chr(1), family), genus, concat(domain, chr(1), family, chr(1), genus), 0 from leaves
      union select distinct concat(domain, chr(1), family, chr(1), genus), accession, concat(domain, chr(1), family, chr(1), genus, chr(1), accession), 1 from leaves),
    marked as (select *, case when name = min(name) over (partition by parent) then '' else ',' end as comma from nodes),
    tokens as (
      select concat(path, case leaf when 0 then concat(chr(1), chr(1)) else '' end) as k, concat(comma, case leaf when 1 then {_CLEAN.format("name")} else '(' end) as token from marked
      union all select concat(path, chr(1), chr(65535)), concat(')', {_CLEAN.format("name")}) from marked where leaf = 0
      union all select '', '(' union all select chr(65535), ')root;')
    select cast(row_number() over (order by k) - 1 as bigint) as position, token from tokens"""
)
def newick_tree(t):
    """Tokens of the taxonomy tree in order."""
    from readframe.operators.scan import running_before

    tokens = X.newick_tokens(t("genomes"), ["domain", "family", "genus"])
    # Positions by a scan over key prefixes: few tokens share one.
    counted = tokens.withColumns({"one": F.lit(1).cast("long"), "all_rows": F.lit(0)})
    scanned = running_before(counted, ["all_rows"], "sort_key", F.substr("sort_key", F.lit(1), F.lit(24)), {"position": ("sum", "one")})
    return scanned.select("position", "token")


# ---- data sets ----


@query(f"with {_CLASSES} select class_id, rf0, rf1, rf2 from classes")
def label_classes(t):
    """Numbered label triples of all reads, as far as all three frames of a read go."""
    return DS.number_triples(DS.label_triples(t("labelled")))


@query(
    f"""
    with arrays as (select name, 0 as rf, rf0_labels as labels from {{labelled}}
                    union all select name, 1, rf1_labels from {{labelled}} union all select name, 2, rf2_labels from {{labelled}}),
    flat as (select name, rf, unnest(labels) as label, generate_subscripts(labels, 1) as i from arrays),
    marked as (select name, rf, i, case when label = 1 and lag(label) over w = 0 then 4 when label = 1 and lead(label) over w = 0 then 5 else label end as label
               from flat window w as (partition by name, rf order by i)),
    triples as (select distinct a.label as rf0, b.label as rf1, c.label as rf2 from marked a join marked b on a.name = b.name and a.i = b.i and a.rf = 0 and b.rf = 1
                join marked c on a.name = c.name and a.i = c.i and c.rf = 2)
    select cast(row_number() over (order by rf0, rf1, rf2) - 1 as int) as class_id, cast(rf0 as tinyint) as rf0, cast(rf1 as tinyint) as rf1, cast(rf2 as tinyint) as rf2 from triples"""
)
def bordered_label_classes(t):
    """Label triples after indel borders are marked."""
    return DS.label_classes(t("labelled"))


_TYPES = """
    types as (
      select name, case when (list_contains(rf0_labels, 0) and list_contains(rf0_labels, 1) or list_contains(rf1_labels, 0) and list_contains(rf1_labels, 1) or list_contains(rf2_labels, 0) and list_contains(rf2_labels, 1)) and length % 3 = 0 then 'transition_indel'
             when list_contains(list_concat(rf0_labels, list_concat(rf1_labels, rf2_labels)), 2) and list_contains(list_concat(rf0_labels, list_concat(rf1_labels, rf2_labels)), 3) then 'transition_start_stop'
             when list_contains(list_concat(rf0_labels, list_concat(rf1_labels, rf2_labels)), 2) then 'transition_start'
             when list_contains(list_concat(rf0_labels, list_concat(rf1_labels, rf2_labels)), 3) then 'transition_stop'
             when length < 9 then 'non-coding' when length % 3 = 1 then 'coding_with_substitutions' else 'coding' end as seq_desc
      from {labelled})"""


@query(f"with {_TYPES} select seq_desc, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from types group by seq_desc")
def sequence_type_shares(t):
    """Share of each read description; the read length decides what indels and substitutions would."""
    labels = [F.col(f"rf{rf}_labels") for rf in range(3)]
    n = F.col("length")
    desc = L.sequence_type(labels, n % 3 == 0, n >= 9, n % 3 == 1)
    return DS.type_shares(t("labelled").withColumn("seq_desc", desc)).withColumn("share", F.round("share", 6))


@query(
    """
    with sizes as (select l_returnflag, l_linenumber, count(*) as n from (select distinct * from {lineitem}) group by all)
    select l_returnflag, l_linenumber, cast(round_even(0.1 * n, 0) as bigint) as n_sampled from sizes where round_even(0.1 * n, 0) > 0"""
)
def stratified_sample_sizes(t):
    """Rows per stratum of an exact ten percent sample."""
    rows = t("lineitem").distinct().withColumn("row_key", F.to_json(F.struct("*")))
    sample = DS.fraction_per_stratum(rows, ["l_returnflag", "l_linenumber"], 0.1, "row_key")
    return sample.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n_sampled"))


_ORDER_WEIGHTS = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.5}

# Weights in halves, so that all bounds are whole numbers.
_WEIGHTED = f"""
    weighed as (select o_orderkey, o_orderpriority, w.weight from {{orders}} o join (values {', '.join(f"('{k}', {v})" for k, v in _ORDER_WEIGHTS.items())}) w(name, weight) on o.o_orderpriority = w.name),
    shares_of as (select o_orderpriority, count(*) as n, cast(2 * any_value(weight) * count(*) as hugeint) as part from weighed group by o_orderpriority),
    bounds as (
      select o_orderpriority, n, {2**DRAW_BITS} :: hugeint * coalesce(sum(part) over (order by o_orderpriority rows between unbounded preceding and 1 preceding), 0) // sum(part) over () as since,
             {2**DRAW_BITS} :: hugeint * sum(part) over (order by o_orderpriority) // sum(part) over () as upto from shares_of),
    throws as (select i as draw_id, {draw_sql("42", "i")} as u, {draw_sql("43", "i")} as v from (select unnest(range(0, (select count(*) from {{orders}}))) as i)),
    numbered as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {draw_sql("44", "o_orderkey")}, o_orderkey) - 1 as place from weighed),
    chosen as (
      select draw_id, x.o_orderpriority, x.o_orderkey from throws t join bounds b on t.u >= b.since and t.u < b.upto
      join numbered x on x.o_orderpriority = b.o_orderpriority and x.place = t.v % b.n)"""


@query(f"with {_WEIGHTED} select draw_id, o_orderpriority, o_orderkey from chosen")
def weighted_sample(t):
    """As many orders as there are, drawn with replacement and priority weights."""
    orders = t("orders")
    return DS.weighted_with_replacement(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", _ORDER_WEIGHTS, orders.count(), "o_orderkey")


_FAMILIES = """
    fams as (select domain, family, count(*) as n, avg(gc_content) as mean_gc from {genomes} group by all),
    ranked as (select *, row_number() over (partition by domain order by mean_gc, family) - 1 as gc_rank from fams)"""


@query(f"with {_FAMILIES} select domain, family, n, round(mean_gc, 6) as mean_gc, cast(gc_rank as int) as gc_rank from ranked")
def family_statistics(t):
    return DS.family_stats(t("genomes")).withColumn("mean_gc", F.round("mean_gc", 6))


# Validation families as a walk over the families of a domain in the order they are considered.
_VALIDATION = """
    totals as (select domain, count(*) as nf, sum(n) * 0.10 as target, greatest(1, cast(floor(count(*) * 0.12) as int)) as k from {src} group by domain),
    firsts as (select distinct domain, cast(floor(i * nf / k) as int) as idx from totals, (select unnest(range(0, 1000)) as i) where i < k),
    flagged as (
      select r.*, t.target, exists (select 1 from firsts f where f.domain = r.domain and f.idx = r.gc_rank) as is_first,
             (select min(abs(f.idx - r.gc_rank)) from firsts f where f.domain = r.domain) as dist from {src} r join totals t on r.domain = t.domain),
    considered as (select *, row_number() over (partition by domain order by is_first desc, dist desc, gc_rank) as step from flagged),
    walk(domain, step, have, picked) as (
      select domain, 0 :: bigint, 0 :: double, [] :: varchar[] from (select distinct domain from considered)
      union all
      select w.domain, c.step, case when take then have + n else have end, case when take then list_append(picked, family) else picked end
      from (select w.*, c.family, c.n, c.step as cstep, c.is_first or (w.have < c.target * 0.95 and w.have + c.n <= c.target * 1.10) as take
            from walk w join considered c on c.domain = w.domain and c.step = w.step + 1) w join considered c on c.domain = w.domain and c.step = w.cstep),
    final as (select domain, unnest(picked) as family from walk w where step = (select max(step) from considered c where c.domain = w.domain))"""
_VALIDATION = _VALIDATION.replace(
    "select w.domain, c.step, case when take", "select w.domain, w.cstep, case when take"
).replace(") w join considered c on c.domain = w.domain and c.step = w.cstep),", ") w),")


@query(f"with {_FAMILIES}, {_VALIDATION.replace('{src}', 'ranked')} select domain, family from final", recursive=True)
def validation_families(t):
    return DS.validation_families(t("genomes"))


@query(
    f"""
    with seeds as (select concat('g', o_custkey) as accession from {{orders}} where o_totalprice > 499500),
    test_families as (select distinct family from {{genomes}} where accession in (select accession from seeds)),
    fams as (select domain, family, count(*) as n, avg(gc_content) as mean_gc from {{genomes}} where family not in (select family from test_families) group by all),
    ranked as (select *, row_number() over (partition by domain order by mean_gc, family) - 1 as gc_rank from fams),
    {_VALIDATION.replace("{src}", "ranked")}
    select accession, case when family in (select family from test_families) then 'test' when exists (select 1 from final f where f.domain = g.domain and f.family = g.family) then 'val' else 'train' end as partition
    from {{genomes}} g""",
    recursive=True,
)
def family_split(t):
    """Family-disjoint partitions; families of the dearest orders' genomes are the test set."""
    seeds = t("orders").filter("o_totalprice > 499500").select(F.concat(F.lit("g"), "o_custkey").alias("accession"))
    return DS.split_by_family(t("genomes").drop("partition"), seeds).select("accession", "partition")


@query(
    """
    select g.accession, case when g.accession in (select concat('g', o_custkey) from {orders} where o_orderpriority = '5-LOW') then 'val'
                             when g.accession in (select concat('g', o_custkey) from {orders} where o_orderpriority = '1-URGENT') then 'train' else 'none' end as partition from {genomes} g"""
)
def partition_labels(t):
    """Membership in two accession lists; an accession in both counts for the later list."""
    orders = t("orders").withColumn("accession", F.concat(F.lit("g"), "o_custkey"))
    lists = {"train": orders.filter("o_orderpriority = '1-URGENT'"), "val": orders.filter("o_orderpriority = '5-LOW'")}
    return DS.partition_label(t("genomes"), lists).select("accession", "partition")


@query(
    """
    select partition, domain, cast(grouping(partition, domain) as int) as grouping_id, count(*) as n_genomes, count(distinct family) as n_families, min(gc_content) as gc_min, max(gc_content) as gc_max,
           round(avg(gc_content), 6) as gc_mean, round(median(gc_content), 6) as gc_median from {genomes} group by grouping sets ((partition), (partition, domain))"""
)
def partition_report(t):
    report = DS.partition_report(t("genomes"))
    return report.withColumns({c: F.round(c, 6) for c in ("gc_mean", "gc_median")})


_QUOTAS = """
    sizes as (select family, count(*) as n, sum(count(*)) over () as total from {genomes} group by family),
    ends as (select distinct family from {genomes} where accession in (
       (select accession from {genomes} order by gc_content, accession limit 1) union all (select accession from {genomes} order by gc_content desc, accession limit 1))),
    base as (select s.family, n, n / total * 100 as exact, e.family is not null as is_end from sizes s left join ends e on s.family = e.family),
    rounded as (select *, case when is_end then greatest(1, round_even(exact, 0)) else round_even(exact, 0) end as q from base),
    gap as (select *, 100 - sum(q) over () as diff, count(*) filter (where q > 0) over () as slots from rounded),
    turns as (select *, row_number() over (partition by q > 0 order by case when diff > 0 then -(exact - floor(exact)) else exact - floor(exact) end, n desc, family) - 1 as r from gap),
    quotas as (
      select family, n, case when q = 0 then 0 when diff > 0 then q + floor(abs(diff) / slots) + case when r < abs(diff) % slots then 1 else 0 end
             else greatest(q - floor(abs(diff) / slots) - case when r < abs(diff) % slots then 1 else 0 end, case when is_end then 1 else 0 end) end as quota from turns)"""


@query(f"with {_QUOTAS} select family, n, cast(quota as bigint) as quota from quotas")
def family_quotas(t):
    """Genomes per family in a proportional sample of a hundred."""
    return DS.family_quotas(t("genomes"), 100)


@query(f"with {_QUOTAS} select family, cast(quota as bigint) as n_sampled from quotas where quota > 0")
def proportional_sample_sizes(t):
    """Genomes per family of the drawn sample of a hundred; quotas are met as every family is large enough."""
    sample = DS.proportional_subsample(t("genomes"), 100)
    return sample.groupBy("family").agg(F.count("*").alias("n_sampled"))


# Both ends first, then each family's quota by draw, then the rest by a race weighted by family size.
_PROPORTIONAL = f"""
    both_ends as ((select accession from {{genomes}} order by gc_content, accession limit 1) union (select accession from {{genomes}} order by gc_content desc, accession limit 1)),
    drawn as (
      select g.accession, g.family, g.gc_content, q.n as size, q.quota, (select sum(n * n) / sum(n) from quotas) as mean_size,
             8 * {draw_sql("1", "g.accession")} as key, (8 * {draw_sql("2", "g.accession")} + 1) / cast(9223372036854775808 as double) as uniform, e.accession is not null as is_end
      from {{genomes}} g join quotas q on g.family = q.family left join both_ends e on g.accession = e.accession),
    own as (select *, row_number() over (partition by family order by case when is_end then 0 else key end, accession) <= quota as is_own from drawn),
    tiers as (select *, case when is_end then 0 when is_own then 1 else 2 end as tier, 1 - exp(ln(uniform) / size * mean_size) as race from own),
    sample as (
      select * from tiers qualify row_number() over (order by tier, case when tier < 2 then key // 16 end, race, accession) <= 100)"""


@query(f"with {_QUOTAS}, {_PROPORTIONAL} select accession, family, gc_content from sample")
def proportional_sample(t):
    return DS.proportional_subsample(t("genomes"), 100).select("accession", "family", "gc_content")


@query(
    """
    with s as (select * from {genomes} where partition = 'train'), f as (select family, count(*) as n from s group by family)
    select count(*) as n_genomes, min(gc_content) as gc_min, max(gc_content) as gc_max, round(avg(gc_content), 6) as gc_mean, round(median(gc_content), 6) as gc_median,
           (select count(*) from f) as n_families, round((select avg(n) from f), 6) as mean_genomes_per_family, (select min(n) from f) as family_min, (select median(n) from f) as family_median,
           (select max(n) from f) as family_max, (select count(*) from {genomes}) as n_population from s"""
)
def sample_report(t):
    report = DS.sample_report(t("genomes").filter("partition = 'train'"), t("genomes"))
    return report.withColumns({c: F.round(c, 6) for c in ("gc_mean", "gc_median", "mean_genomes_per_family")})


@query(
    """
    with b as (select domain, count(*) as n_before, count(distinct family) as families_before from {genomes} group by all),
    a as (select domain, count(*) as n_after, count(distinct family) as families_after from {genomes} where partition = 'train' group by all)
    select b.domain, n_before, families_before, round(n_before / sum(n_before) over (), 6) as share_before, n_after, families_after, round(n_after / sum(n_after) over (), 6) as share_after
    from b left join a on a.domain = b.domain"""
)
def domain_shares(t):
    shares = DS.domain_shares(t("genomes").filter("partition = 'train'"), t("genomes"))
    return shares.withColumns({c: F.round(c, 6) for c in ("share_before", "share_after")})


@query(
    """
    select dataset, a.accession, count(*) as n_reads, any_value(species) as species, any_value(partition) as partition
    from {alignments} a left join {genomes} g on a.accession = g.accession group by dataset, a.accession"""
)
def reads_per_genome(t):
    return DS.read_counts_per_genome(t("alignments"), t("genomes"))


@query("select accession from {genomes} except select concat('g', o_custkey) as accession from {orders} where o_orderstatus = 'P'")
def unfinished_genomes(t):
    """Genomes without any order that is under way."""
    done = t("orders").filter("o_orderstatus = 'P'")
    return X.unfinished(t("genomes"), done.select(F.concat(F.lit("g"), "o_custkey").alias("accession")))


@query(
    """
    select concat('g', o_custkey) as accession from {orders} where o_orderstatus = 'F'
    union select concat('g', c_custkey) from {customer} where c_acctbal > 9000"""
)
def seed_genomes(t):
    """Distinct union of two accession lists."""
    first = t("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("g"), "o_custkey").alias("accession"))
    second = t("customer").filter("c_acctbal > 9000").select(F.concat(F.lit("g"), "c_custkey").alias("accession"))
    return X.union_lists(first, second)
