"""Error strings, annotations and labels of aligned reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from readframe.functions import errors as E
from readframe.functions import labels as L
from readframe.operators import genomes as G
from readframe.operators import intervals as I
from readframe.operators.read_arrays import nonzero_labels
from readframe.operators import frameshift as X
from readframe.queries.inputs import READ_LENGTH
from readframe.queries.registry import query
from readframe.session import spread

# One row per CIGAR operation.
_OPS = """
    ops as (
      select read_id, assembly_id, strand, start, md, dataset, i,
             regexp_extract_all(cigar, '(\\d+)([MID])', 2)[i] as op, cast(regexp_extract_all(cigar, '(\\d+)([MID])', 1)[i] as int) as len
      from {alignments}, (select unnest(range(1, 8)) as i)
      where i <= len(regexp_extract_all(cigar, '(\\d+)([MID])', 1)))"""


@query(f"with {_OPS} select read_id, cast(i - 1 as int) as pos, op, len from ops")
def cigar_operations(t):
    ops = E.parse_cigar(F.col("cigar"))
    return t("alignments").select("read_id", F.posexplode(ops).alias("pos", "o")).select("read_id", "pos", "o.*")


# Inserted bases (0-based read positions) and the tokens of MD strings with their running offsets.
_INSERTED = """
    places as (select *, sum(case when op in ('M', 'I') then len else 0 end) over (partition by read_id order by i rows between unbounded preceding and 1 preceding) as before from ops),
    inserted as (
      select read_id, list(cast(coalesce(before, 0) + j as int) order by before, j) as ins
      from places, (select unnest(range(0, 5)) as j) where op = 'I' and j < len group by read_id)"""
_MD_ERRORS = """
    tokens as (
      select read_id, i, regexp_extract_all(md, '\\d+|\\^[A-Z]+|[A-Z]')[i] as tok
      from {alignments}, (select unnest(range(1, 30)) as i)
      where i <= len(regexp_extract_all(md, '\\d+|\\^[A-Z]+|[A-Z]')) and md <> '300'),
    sized as (
      select *, case when regexp_matches(tok, '^\\d') then cast(tok as int) when tok[1] = '^' then length(tok) - 1 else 1 end as size from tokens),
    placed as (
      select *, coalesce(sum(size) over w, 0) as pos, coalesce(sum(case when tok[1] = '^' then 1 else 0 end) over w, 0) as dels
      from sized window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding)),
    md_errors as (
      select read_id, i as ord, case when tok[1] = '^' then pos + 1 - dels else pos + 1 end as pos, case when tok[1] = '^' then 'D' else tok end as kind
      from placed where not regexp_matches(tok, '^\\d') and pos <= 300),
    all_errors as (
      select * from md_errors
      union all
      select n.read_id, j - 100, ins[j] + 1, 'I' from inserted n join {alignments} a on a.read_id = n.read_id, (select unnest(range(1, 8)) as j)
      where j <= len(ins) and a.md <> '300')"""


@query(
    f"""
    with {_OPS}, {_INSERTED}, {_MD_ERRORS}
    select a.read_id, coalesce(string_agg(concat(e.pos, e.kind), ',' order by ord), '') as errors
    from {{alignments}} a left join all_errors e on a.read_id = e.read_id group by a.read_id"""
)
def md_errors(t):
    return t("alignments").select("read_id", E.error_string(_errors()).alias("errors"))


def _errors():
    insertions = L.insertion_positions(E.parse_cigar(F.col("cigar")))
    return E.errors_from_md(F.col("md"), F.lit(READ_LENGTH), insertions)


@query(
    f"""
    with {_OPS}, {_INSERTED}, {_MD_ERRORS},
    moved as (
      select read_id, pos, kind,
             pos + coalesce(sum(case kind when 'I' then 1 when 'D' then -1 else 0 end) over (partition by read_id order by pos, kind rows between unbounded preceding and 1 preceding), 0) as new_pos
      from all_errors)
    select a.read_id, coalesce(string_agg(concat(m.new_pos, m.kind), ',' order by m.pos, m.kind), '') as errors
    from {{alignments}} a left join moved m on a.read_id = m.read_id group by a.read_id"""
)
def shifted_errors(t):
    """Errors moved by the indels before them; no read here has two deletions side by side."""
    return t("alignments").select("read_id", E.error_string(E.shift_by_indels(_errors())).alias("errors"))


@query("select read_id, md from {alignments} where not contains(md, '^')")
def substitution_only_reads(t):
    return t("alignments").filter(~E.has_deletion(F.col("md"))).select("read_id", "md")


@query(
    """
    with t as (select name, seq, 1 + input_order % 37 as p, 40 + input_order % 11 as q from {reads})
    select name, case when length(seq) >= q then concat(substr(seq, 1, p - 1), 'A', substr(seq, p + 1, q - p - 1), 'T', substr(seq, q + 1))
                      when length(seq) >= p then concat(substr(seq, 1, p - 1), 'A', substr(seq, p + 1)) else seq end as restored
    from t"""
)
def restored_reads(t):
    """Two substitutions per read undone; an error past the read end changes nothing."""
    p, q = (F.col("input_order") % 37 + 1).cast("int"), (F.col("input_order") % 11 + 40).cast("int")
    errors = F.array(F.struct(p.alias("pos"), F.lit("A").alias("kind")), F.struct(q.alias("pos"), F.lit("T").alias("kind")))
    return t("reads").select("name", E.restore_substitutions(F.col("seq"), errors).alias("restored"))


def _dataset_reads(t):
    reads = t("alignments").withColumn("indel_positions", E.error_string(E.only_indels(_errors())))
    return reads.withColumnsRenamed({"cigar": "CIGAR", "md": "MD"})


_ERROR_COUNTS = f"""
    with {_OPS}, {_INSERTED}, {_MD_ERRORS},
    counts as (
      select a.read_id, any_value(a.dataset) as dataset,
             any_value(length(regexp_replace(regexp_replace(a.md, '\\^[ACGT]+', '', 'g'), '[^ACGT]', '', 'g'))) as substitutions,
             count(*) filter (where e.kind in ('I', 'D')) as indels,
             (select sum(len) from ops o where o.read_id = a.read_id and op in ('M', 'I')) as length
      from {{alignments}} a left join all_errors e on a.read_id = e.read_id group by a.read_id)"""


@query(
    _ERROR_COUNTS
    + """
    select dataset, count(*) as n_reads, round(sum(substitutions) / sum(length), 8) as substitution_rate,
           round(sum(indels) / sum(length), 8) as indel_rate, round(avg(substitutions), 6) as mean_substitutions,
           cast(max(substitutions) as int) as max_substitutions, round(avg(indels), 6) as mean_indels, cast(max(indels) as int) as max_indels,
           cast(regexp_extract(dataset, '([0-9.e-]+)i_', 1) as double) as nominal_indel_rate,
           cast(regexp_extract(dataset, 'i_([0-9.e-]+)s', 1) as double) as nominal_substitution_rate
    from counts group by dataset"""
)
def error_report(t):
    report = G.error_report(_dataset_reads(t))
    rounded = {c: F.round(c, 8) for c in ("substitution_rate", "indel_rate")}
    return report.withColumns(rounded | {c: F.round(c, 6) for c in ("mean_substitutions", "mean_indels")})


@query(
    _ERROR_COUNTS
    + """
    select dataset, 'substitutions' as kind, cast(substitutions as int) as n_errors, count(*) as n_reads from counts group by all
    union all select dataset, 'indels', cast(indels as int), count(*) from counts group by all"""
)
def error_histogram(t):
    return G.error_histogram(_dataset_reads(t))


_PAIR = "a.assembly_id = c.assembly_id and a.strand = c.strand and a.start <= c.cds_end and c.cds_start <= a.\"end\""


@query(
    f"""
    select a.read_id, c.cds_start, c.cds_end, count(*) as n
    from {{alignments}} a join {{annotations}} c on {_PAIR} group by all"""
)
def read_cds_overlap(t):
    reads = t("alignments").select("read_id", "assembly_id", "strand", "start", "end")
    pairs = I.overlap_pairs(reads, t("annotations").drop("certain"))
    return pairs.groupBy("read_id", "cds_start", "cds_end").agg(F.count("*").alias("n"))


@query(
    """
    select a.read_id, a.assembly_id, a.start from {alignments} a
    where not exists (select 1 from {annotations} u where not u.certain and u.assembly_id = a.assembly_id and u.strand = a.strand
                      and a.start between u.cds_start - 300 and u.cds_end)"""
)
def reads_off_uncertain_cds(t):
    reads = t("alignments").select("read_id", "assembly_id", "strand", "start")
    free = I.without_uncertain(reads, t("annotations").filter("not certain"), READ_LENGTH)
    return free.select("read_id", "assembly_id", "start")


_ISLANDS = """
    with ordered as (
      select assembly_id, strand, cds_start, cds_end,
             max(cds_end) over (partition by assembly_id, strand order by cds_start, cds_end rows between unbounded preceding and 1 preceding) as reach
      from {annotations}),
    numbered as (
      select *, sum(case when reach is null or cds_start > reach then 1 else 0 end) over (partition by assembly_id, strand order by cds_start, cds_end rows unbounded preceding) as island
      from ordered)"""


@query(
    _ISLANDS
    + """ select assembly_id, strand, min(cds_start) as region_start, max(cds_end) as region_end, count(*) as n_cds
    from numbered group by assembly_id, strand, island"""
)
def merged_regions(t):
    return I.merge_regions(t("annotations"), ["assembly_id", "strand"])


_CHECKED = """
    longest as (select assembly_id, strand, cds_start, max(cds_end) as cds_end from {annotations} where certain group by all),
    widest as (select assembly_id, strand, min(cds_start) as cds_start, cds_end from longest group by assembly_id, strand, cds_end),
    checked as (
      select distinct * from (
        select assembly_id, strand, cds_start, cds_end, (cds_end - 2 - cds_start) % 3 = 0 as certain from widest
        union all select assembly_id, strand, cds_start, cds_end, certain from {annotations} where not certain))"""


@query(f"with {_CHECKED} select * from checked")
def checked_annotations(t):
    return I.check_annotations(t("annotations"))


@query(
    """
    with t as (select part.p_partkey, lower(concat('ID=', p_name, ';product=', case p_size % 4 when 0 then 'hypothetical protein' when 1 then p_type else p_brand end,
                      case p_size % 5 when 0 then ';pseudo=true' when 1 then ';partial=true' when 2 then ';gbkey=pseudogene' else '' end)) as a
               from {part})
    select concat('c', p_partkey) as assembly_id, '+' as strand, p_partkey as cds_start, p_partkey + 300 as cds_end,
           regexp_matches(a, 'pseudo=true|product=hypothetical protein|partial=true|ab initio prediction|note=programmed frameshift') = false as certain
    from t where regexp_matches(a, 'pseudo=true|product=hypothetical protein|partial=true') or not contains(a, 'pseudogene')"""
)
def annotation_classes(t):
    size = F.col("p_size")
    product = F.when(size % 4 == 0, "hypothetical protein").when(size % 4 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    note = F.when(size % 5 == 0, ";pseudo=true").when(size % 5 == 1, ";Partial=true").when(size % 5 == 2, ";gbkey=Pseudogene").otherwise("")
    gff = t("part").select(
        F.concat(F.lit("c"), "p_partkey").alias("seqid"), F.lit("CDS").alias("type"), F.col("p_partkey").alias("start"),
        (F.col("p_partkey") + 300).alias("end"), F.lit("+").alias("strand"),
        F.concat(F.lit("ID="), "p_name", F.lit(";product="), product, note).alias("attributes"),
    )
    return I.classify_annotations(gff)


_RECORDS = """
    records as (
      select concat('g', doc_id % 20) as accession, s.source_rank, doc_id as ordinal, concat(s.prefix, doc_id) as name, n_chars as length
      from {documents}, (select 0 as source_rank, 'NZ_' as prefix union all select 1, 'CP') s)"""


@query(
    f"""
    with {_RECORDS},
    per_length as (
      select accession, length, arg_max(name, source_rank * 1000000000 + ordinal) as from_name, arg_min(name, source_rank * 1000000000 + ordinal) as to_name
      from records group by accession, length)
    select accession, from_name, to_name from per_length"""
)
def assembly_names(t):
    sets = F.array(*[F.struct(F.lit(i).alias("source_rank"), F.lit(p).alias("prefix")) for i, p in enumerate(("NZ_", "CP"))])
    records = t("documents").select("doc_id", F.col("n_chars").alias("length"), F.inline(sets))
    return I.assembly_names(
        records.select(
            F.concat(F.lit("g"), F.col("doc_id") % 20).alias("accession"), "source_rank", F.col("doc_id").alias("ordinal"),
            F.concat("prefix", "doc_id").alias("name"), "length",
        )
    )


@query(
    """
    with lengths as (select assembly_id, max(cds_end) + 10 as length from {annotations} group by assembly_id)
    select c.assembly_id, strand, case when strand = '-' then length - cds_end + 1 else cds_start end as cds_start,
           case when strand = '-' then length - cds_start + 1 else cds_end end as cds_end, certain
    from {annotations} c join lengths l on c.assembly_id = l.assembly_id"""
)
def flipped_annotations(t):
    annotations = t("annotations")
    lengths = annotations.groupBy("assembly_id").agg((F.max("cds_end") + 10).alias("length"))
    return I.flip_minus_strand(annotations, lengths)


# Labels of every codon: among the touching CDSs of the frame the last start or stop wins, else coding.
@query(
    f"""
    with {_CHECKED},
    touching as (
      select a.read_id, a.start + rf as frame_start, rf, c.cds_start, c.cds_end, k, a.start + rf + 3 * k as base
      from {{alignments}} a join checked c on {_PAIR} and c.certain, (select unnest([0, 1, 2]) as rf), (select unnest(range(0, 100)) as k)
      where (c.cds_start - a.start - rf) % 3 = 0 and k < (300 - rf) // 3 and a.start + rf + 3 * k between c.cds_start and c.cds_end),
    labelled as (
      select read_id, rf, k, cds_start, cds_end, case when base < cds_start + 3 then 2 when base > cds_end - 3 then 3 else 1 end as label from touching)
    select read_id, cast(rf as int) as rf, cast(k as int) as codon,
           cast(coalesce(arg_max(label, cds_start * 1000000 + cds_end) filter (where label > 1), 1) as tinyint) as label
    from labelled group by read_id, rf, k"""
)
def frame_labels(t):
    """Non-zero codon labels of all reads, taken as if they had no indel."""
    reads = I.attach_cds(_placed(t), _certain(t), READ_LENGTH)
    return _nonzero(reads, lambda rf: L.frame_labels(F.col("start"), F.lit(READ_LENGTH), F.col("cds"), rf))


def _placed(t):
    # Every read is hundreds of labels, so the reads are dealt out to all cores.
    return spread(t("alignments").select("read_id", "assembly_id", "strand", "start", "end", "cigar"))


def _certain(t):
    return I.check_annotations(t("annotations")).filter("certain")


def _nonzero(reads, labels):
    frames = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda rf: F.struct(rf.alias("rf"), labels(rf).alias("labels")))
    # Outer, as Spark filters by the size of the array of a plain inline first and would make the labels a second time.
    rows = reads.select("read_id", F.inline_outer(frames)).select("read_id", "rf", F.posexplode("labels").alias("codon", "label"))
    return rows.filter("label != 0")


# The same through insertions and deletions: a CDS moves with the operations before the base.
@query(
    f"""
    with {_CHECKED}, {_OPS},
    first_cut as (
      select read_id, assembly_id, strand, start, rf, i, op, case when i = 1 then len - rf else len end as len
      from ops, (select unnest([0, 1, 2]) as rf)),
    walked as (
      select *, coalesce(sum(case when op in ('M', 'I') then len else 0 end) over w, 0) as from_pos,
             coalesce(sum(case op when 'I' then len when 'D' then -len else 0 end) over w, 0) as shift
      from first_cut where len >= 1 window w as (partition by read_id, rf order by i rows between unbounded preceding and 1 preceding)),
    bases as (
      select read_id, assembly_id, strand, start + rf as frame_start, rf, op, shift, from_pos + j as pos
      from walked, (select unnest(range(0, 300)) as j) where op in ('M', 'I') and j < len and from_pos + j < (300 - rf) // 3 * 3),
    touching as (
      select b.*, c.cds_start, b.frame_start + pos - shift as base, c.cds_end
      from bases b join checked c on b.assembly_id = c.assembly_id and b.strand = c.strand and c.certain and b.op = 'M'
       and c.cds_start <= b.frame_start - rf + 299 and c.cds_end >= b.frame_start - rf
       and b.frame_start + pos - shift between c.cds_start and c.cds_end and (c.cds_start + shift - b.frame_start) % 3 = 0),
    nt as (
      select read_id, rf, pos, coalesce(arg_max(case when base < cds_start + 3 then 2 else 3 end, cds_start * 1000000 + cds_end)
             filter (where base < cds_start + 3 or base > cds_end - 3), 1) as label
      from touching group by read_id, rf, pos)
    select read_id, cast(rf as int) as rf, cast(pos // 3 as int) as codon, cast(arg_min(label, pos) as tinyint) as label
    from nt group by read_id, rf, pos // 3 having count(*) = 3"""
)
def frame_labels_with_indels(t):
    """Non-zero codon labels of all reads through their CIGAR."""
    return nonzero_labels(I.attach_cds(_placed(t), _certain(t), READ_LENGTH), READ_LENGTH)


# A walk over the breaks of a call: its indels in order, then the base behind its end.
@query(
    """
    with calls as (
      select distinct read_name, start * 1000000 + "end" * 100 + rf as call, cast(start as int) as start, cast(case when "end" = 297 then 300 else "end" end as int) as e, rf,
             start + 10 as ins, "end" - 9 as del from {pred}),
    cuts as (select *, list_append(list_sort(list_distinct([ins, del])), e + 1) as breaks from calls),
    walk(read_name, call, start, e, ins, del, breaks, k, at_base, frame, from_base, to_base, piece_frame) as (
      select read_name, call, start, e, ins, del, breaks, 0, start, rf, null :: int, null :: int, null :: int from cuts
      union all
      select read_name, call, start, e, ins, del, breaks, k + 1, case when b = ins and b <> del then b + 1 else b end,
             case when b = del then (frame + 2) % 3 when b = ins then (frame + 1) % 3 else frame end,
             case when usable then a end, case when usable then z - (z - a + 1 + 300) % 3 end, frame
      from (
        select *, f + (1 - f + frame + 3000) % 3 as a, at_base <= b - 1 and at_base <= e and b - 1 >= start and f <= z as usable
        from (select *, greatest(at_base, start) as f, least(b - 1, e) as z from (select *, breaks[cast(k + 1 as bigint)] as b from walk where k < len(breaks)) x) y) w)
    select read_name, cast(call as varchar) as cds_group, cast(from_base as int) as start, cast(to_base as int) as "end", cast(piece_frame as int) as rf
    from walk where from_base is not null and to_base > from_base""",
    recursive=True,
)
def caller_pieces(t):
    """Predicted CDSs cut at two indel positions each."""
    from readframe.sources.tables import caller_pieces as cut

    distinct = t("pred").select("read_name", "start", "end", "rf").distinct()
    calls = distinct.select(
        "read_name", (F.col("start").cast("long") * 1_000_000 + F.col("end") * 100 + F.col("rf")).alias("call"), "start", "end", "rf",
        F.array((F.col("start") + 10).cast("int")).alias("insertions"), F.array((F.col("end") - 9).cast("int")).alias("deletions"),
    )
    return cut(calls, READ_LENGTH).select("read_name", "cds_group", "start", "end", "rf")


@query(
    """
    select model, testset, accession, read_name, cds_group, cast((a_end + b_start) // 2 as int) as pos, 'I' as kind from (
      select model, testset, accession, read_name, cds_group, min("end") as a_end, max(start) as b_start, count(*) as n
      from {pred} where cds_group is not null group by all) where n = 2"""
)
def predicted_indels(t):
    """Indels in the gaps of chained predictions."""
    keys = ["model", "testset", "accession", "read_name", "cds_group"]
    chains = t("pred").filter("cds_group is not null").groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "rf")).alias("f"))
    return chains.select(*keys, F.inline(X.gap_indels(F.col("f"))))
