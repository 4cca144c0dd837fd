"""Parsers and writers of text formats, over lines made of the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readframe.plans import annotations
from readframe.queries.alignments import _CHECKED
from readframe.queries.registry import query
from readframe.sources import fasta, gff, sinks, tables


def _text(*parts):
    """Columns and literals one after another as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _fields(*parts):
    return F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _records(t, header):
    """FASTA records of all reads, wrapped after 60 bases, in lower case, with Windows line ends in every other one."""
    even = F.col("input_order") % 2 == 0
    wrapped = F.regexp_replace(F.lower("seq"), "(.{60})", F.when(even, "$1\r\n").otherwise("$1\n"))
    value = F.concat(F.when(F.col("input_order") == 0, ">").otherwise(""), header, F.lit("\n"), wrapped)
    return t("reads").select("input_order", F.lit("f").alias("file_path"), value.alias("value"))


@query("select input_order, name, seq from {reads}")
def fasta_reads(t):
    """Names and sequences of FASTA records."""
    return fasta.named_reads(fasta.parse_records(_records(t, _text(F.col("name"), " some words"))))


@query(
    """
    select name as read_name, case when input_order % 3 = 0 then null else '+' end as strand, case when input_order % 3 = 0 then null else accession end as assembly_id,
           cast(case when input_order % 3 = 2 then 2 else 0 end as int) as n_cds, case when input_order % 3 = 2 then input_order % 50 + 1 end as first_start,
           case when input_order % 6 = 2 then '7I' end as indel_positions, length(seq) as n
    from {reads}"""
)
def labelled_fasta_reads(t):
    """Reads with pipe headers: only a name, without coordinates, and with coordinates and errors."""
    start = F.col("input_order") % 50 + 1
    third = F.col("input_order") % 3
    coords = _text("[[", start, ", ", start + 29, ", '0'], [", start + 31, ", ", start + 60, ", '1']]")
    errors = F.when(F.col("input_order") % 6 == 2, "7I").otherwise("None")
    header = F.when(third == 0, F.col("name")).when(third == 1, _text(F.col("name"), "|+|", F.col("accession"))).otherwise(_text(F.col("name"), "|+|", F.col("accession"), "|", coords, "|", errors))
    reads = fasta.labelled_reads(fasta.parse_records(_records(t, header)))
    first = F.get("cds_coords", F.lit(0))["start"].cast("long")
    return reads.select("read_name", "strand", "assembly_id", F.size("cds_coords").alias("n_cds"), first.alias("first_start"), "indel_positions", F.length("read").cast("long").alias("n"))


# Line items as annotation lines: CDSs on both strands, some in groups, codon features, comments and broken lines.
def _gff_lines(t):
    item = t("lineitem")
    start = F.col("l_partkey") % 200 + 1
    group = F.when(F.col("l_linenumber") % 2 == 0, _text(";group_id=group_", F.col("l_orderkey"), ".", F.col("l_linenumber"))).otherwise("")
    kind = F.when(F.col("l_linenumber") == 3, "start_codon").otherwise("CDS")
    strand = F.when(F.col("l_linenumber") % 5 == 0, "-").otherwise("+")
    attributes = F.concat(_text("ID=cds_", F.col("l_linenumber")), group, F.lit(";note=a=b"))
    name = _text("r", F.col("l_orderkey"), "|", F.col("l_suppkey"))
    line = _fields(name, "caller", kind, start, start + 3 * (F.col("l_suppkey") % 40 + 5) - 1, ".", strand, F.col("l_linenumber") % 3, attributes)
    broken = F.when(F.col("l_linenumber") == 6, F.lit("# comment\ta\tb\tc\td\te\tf\tg\th")).when(F.col("l_linenumber") == 7, F.lit("too\tshort"))
    return item.select(F.coalesce(broken, line).alias("value"))


_GFF = """
    items as (select concat('r', l_orderkey, '|', l_suppkey) as seqid, case when l_linenumber = 3 then 'start_codon' else 'CDS' end as type, cast(l_partkey % 200 + 1 as int) as start,
                     cast(l_partkey % 200 + 3 * (l_suppkey % 40 + 5) as int) as "end", case when l_linenumber % 5 = 0 then '-' else '+' end as strand, l_linenumber, l_orderkey
              from {lineitem} where l_linenumber < 6)"""


@query(
    f"""
    with {_GFF}
    select seqid as read_name, case when l_linenumber % 2 = 0 then concat(strand, ':group_', l_orderkey) end as cds_group, start, "end", cast(l_linenumber % 3 as int) as rf
    from items where type = 'CDS'"""
)
def gff_called_cds(t):
    """Predicted CDSs from annotation lines."""
    return gff.called_cds(gff.parse_gff(_gff_lines(t)))


@query(
    f"""
    with {_GFF}
    select split_part(seqid, '|', 1) as read_name, cast(null as varchar) as cds_group, start, "end", cast((start + 2) % 3 as int) as rf from items where type = 'CDS' and strand = '+'"""
)
def gff_gene_caller_cds(t):
    """CDSs of a gene caller, frames from their starts."""
    return gff.gene_caller_cds(gff.parse_gff(_gff_lines(t)))


# Two sets of the same assemblies under other names; the second one's CDSs are every third, longer at the end.
_BOTH_SETS = """
    lengths as (select assembly_id, max(cds_end) + 100 as length from {annotations} group by assembly_id),
    stacked as (
      select assembly_id, strand, cds_start, cds_end, certain from {annotations}
      union all select assembly_id, strand, cds_start, cds_end + 30, certain from {annotations} where cds_start % 3 = 0),
    flipped as (
      select concat('NZ_', s.assembly_id) as assembly_id, strand, case when strand = '-' then length - cds_end + 1 else cds_start end as cds_start,
             case when strand = '-' then length - cds_start + 1 else cds_end end as cds_end, certain
      from stacked s join lengths l on s.assembly_id = l.assembly_id)"""


@query(f"with {_BOTH_SETS}, {_CHECKED.replace('{annotations}', 'flipped')} select * from checked")
def merged_annotation_sets(t):
    """Annotations from the GFF lines of two sets of the same genomes: named alike, flipped, conflicts settled."""
    rows = t("annotations")

    def lines(prefix, of, longer):
        note = F.when(F.col("certain"), F.lit("ID=x;product=kinase")).otherwise("ID=x;pseudo=true")
        fields = [F.concat(F.lit(prefix), "assembly_id"), F.lit("s"), F.lit("CDS"), "cds_start", F.col("cds_end") + longer, F.lit("."), "strand", F.lit("0"), note]
        text = F.concat_ws("\t", *[F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields])
        return gff.parse_gff(of.select(text.alias("value"), F.concat(F.lit("g"), "assembly_id").alias("accession")))

    lengths = rows.groupBy("assembly_id").agg((F.max("cds_end") + 100).alias("length"))
    sets = F.array(*[F.struct(F.lit(i).alias("source_rank"), F.lit(p).alias("prefix")) for i, p in enumerate(("NZ_", "CP"))])
    records = lengths.select("assembly_id", "length", F.inline(sets)).select(
        F.concat(F.lit("g"), "assembly_id").alias("accession"), "source_rank", F.lit(1).alias("ordinal"), F.concat("prefix", "assembly_id").alias("name"), "length"
    )
    kept = lengths.select(F.concat(F.lit("NZ_"), "assembly_id").alias("assembly_id"), "length")
    return annotations.build_annotations(lines("NZ_", rows, 0), lines("CP", rows.filter("cds_start % 3 = 0"), 30), records, kept)


@query("select name, reverse(translate(seq, 'ACGTN', 'TGCAN')) as seq from {reads} where seq <> ''")
def reversed_genome_lines(t):
    """Sequences reversed line by line from the lines of a FASTA file, and put together again."""
    reads = t("reads").filter("seq != ''")
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,70}"), F.lit(0))).alias("line", "value")
    heads = reads.select((F.col("input_order") * 1_000_000).alias("place"), F.concat(F.lit(">"), "name").alias("value"))
    body = reads.select("input_order", pieces).select((F.col("input_order") * 1_000_000 + F.col("line") + 1).alias("place"), "value")
    turned = fasta.reverse_lines(heads.unionByName(body), width=50)
    record = turned.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("turned", "piece", "value"))).alias("r"))
    text = F.transform("r", lambda r: r["value"])
    return record.select(F.substr(F.get(text, F.lit(0)), F.lit(2)).alias("name"), F.array_join(F.slice(text, F.lit(2), F.size(text)), "").alias("seq"))


@query(
    f"""
    with {_GFF}
    select seqid, type, count(*) as n, concat('cds_', l_linenumber) as id, 'a=b' as note from items group by seqid, type, l_linenumber"""
)
def gff_attributes(t):
    """Attributes of annotation lines, one by one."""
    rows = gff.parse_gff(_gff_lines(t))
    named = rows.select("seqid", "type", gff.attribute(F.col("attributes"), "ID").alias("id"), gff.attribute_map(F.col("attributes"))["note"].alias("note"))
    return named.groupBy("seqid", "type", "id", "note").agg(F.count("*").alias("n"))


@query("select concat('file_', c_nationkey) as file_path, cast(min(c_custkey) as varchar) as tax_id from {customer} group by c_nationkey")
def species_taxa(t):
    """The first species pragma of each file."""
    customers = t("customer")
    pragma = _text("##species https://taxa.example/browser?id=", F.col("c_custkey"), " ")
    lines = customers.select(_text("file_", F.col("c_nationkey")).alias("file_path"), F.col("c_custkey").alias("line"), pragma.alias("value"))
    others = customers.select(_text("file_", F.col("c_nationkey")).alias("file_path"), (-F.col("c_custkey")).alias("line"), F.lit("##gff-version 3").alias("value"))
    return gff.parse_species(lines.union(others))


@query(
    """
    select concat('o', o_orderkey) as read_name, cast(k as int) as call, cast(o_custkey % 100 + 10 * k + 1 as int) as start, cast(o_custkey % 100 + 10 * k + 60 as int) as "end", cast(o_orderkey % 3 as int) as rf,
           case when o_orderkey % 4 = 1 then concat(o_custkey % 100 + 12, ',', o_custkey % 100 + 15) else '' end as insertions, case when o_orderkey % 4 = 2 then cast(o_custkey % 100 + 20 as varchar) else '' end as deletions
    from {orders}, (select unnest([0, 2]) as k)"""
)
def caller_out_calls(t):
    """Plus-strand calls of a fragment caller's text, three calls a read, the middle one on the minus strand."""
    base = F.col("o_custkey") % 100
    ins = F.when(F.col("o_orderkey") % 4 == 1, _text("I:", base + 12, ",", base + 15)).otherwise("I:")
    dels = F.when(F.col("o_orderkey") % 4 == 2, _text("D:", base + 20)).otherwise("D:")
    lines = [_fields(base + 10 * k + 1, base + 10 * k + 60, "-" if k == 1 else "+", F.col("o_orderkey") % 3 + 1, "1.3", ins, dels) for k in range(3)]
    value = F.concat(F.when(F.col("o_orderkey") % 2 == 0, ">").otherwise(""), _text("o", F.col("o_orderkey"), "|contig", "\n"), F.concat_ws("\n", *lines), F.lit("\n"))
    calls = tables.parse_caller_out(t("orders").select(value.alias("value")))
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("insertions", "deletions")}
    return calls.withColumns(joined).select("read_name", "call", "start", "end", "rf", "insertions", "deletions")


@query(
    """
    select concat('asm', l_suppkey) as assembly_id, concat('r', l_orderkey, '.', l_linenumber, '_-') as read_id, '-' as strand, cast(l_partkey as int) as start_coordinate,
           case when l_linenumber <> 4 then concat(cast(l_quantity as int), 'M') end as cigar, 'ACGT' as read, case when l_linenumber <> 5 then cast(cast(l_quantity as int) as varchar) end as md, cast(0 as int) as flag
    from {lineitem} where l_linenumber % 3 <> 0"""
)
def sam_alignments(t):
    """Alignments of SAM lines without the reverse-mapped ones, their read ids marked by strand."""
    n = F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_linenumber") % 3 == 0, 16).otherwise(0)
    cigar = F.when(F.col("l_linenumber") == 4, "*").otherwise(_text(n, "M"))
    md = F.when(F.col("l_linenumber") == 5, "XS:i:1").otherwise(_text("MD:Z:", n))
    line = _fields(_text("r", F.col("l_orderkey"), ".", F.col("l_linenumber")), flag, _text("asm", F.col("l_suppkey")), F.col("l_partkey"), "60", cigar, "*", "0", "0", "ACGT", "IIII", "NM:i:0", md, "AS:i:3")
    lines = t("lineitem").select(line.alias("value")).union(t("nation").select(_fields("@SQ", _text("SN:", F.col("n_name"))).alias("value")))
    return tables.with_strand_suffix(tables.forward_only(tables.parse_alignments(lines, "-")))


@query(
    """
    select cast(c_custkey as varchar) as tax_id, concat('n', c_nationkey) as parent_id, 'species' as rank, c_name as name from {customer}
    union all select concat('n', n_nationkey), concat('r', n_regionkey), 'genus', n_name from {nation}"""
)
def taxonomy_dump(t):
    """Nodes and scientific names of a taxonomy dump."""
    bar = "|"
    nodes = t("customer").select(_fields(F.col("c_custkey"), bar, _text("n", F.col("c_nationkey")), bar, "species", bar).alias("value")).union(
        t("nation").select(_fields(_text("n", F.col("n_nationkey")), bar, _text("r", F.col("n_regionkey")), bar, "genus", bar).alias("value"))
    )
    kinds = F.explode(F.array(F.lit("scientific name"), F.lit("synonym"))).alias("kind")
    named = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("n"), kinds).union(
        t("nation").select(_text("n", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("n"), kinds)
    )
    name = F.when(F.col("kind") == "synonym", "other").otherwise(F.col("n"))
    names = named.select(_fields(F.col("id"), bar, name, bar, "", bar, F.col("kind"), bar).alias("value"))
    return tables.parse_tax_nodes(nodes).join(tables.parse_tax_names(names), "tax_id")


@query("select concat('g', c_custkey) as accession from {customer} where c_custkey % 5 <> 0")
def accession_list(t):
    """Accessions of a list with blanks and empty lines."""
    value = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(_text(" g", F.col("c_custkey"), " "))
    return tables.parse_accessions(t("customer").select(value.alias("value")))


_INFO = "accession, strain, species, genus, family, \"order\", class, phylum, domain, genome_length_kb, gc_content, protein_coding_genes, cds_median_length, coding_percentage"


@query(f"select {_INFO} from {{genomes}}")
def genome_info_lines(t):
    """Genome rows from the lines of their CSV file, and their header line left out."""
    columns = _INFO.replace('"', "").split(", ")
    rows = t("genomes").select(F.to_csv(F.struct(*columns)).alias("value"))
    header = t("region").filter("r_regionkey = 0").select(F.lit("," + ",".join(columns[1:])).alias("value"))
    return tables.parse_genome_info(rows.union(header))


@query(
    """
    select name as read_name, cast(len(rf0_labels) as int) as n0, cast(list_sum(rf1_labels) as bigint) as sum1, cast(input_order % 7 + 1 as int) as start, cast(1 as int) as rf
    from (select l.name, rf0_labels, rf1_labels, input_order from {labelled} l join {reads} r on l.name = r.name)"""
)
def labelled_csv_reads(t):
    """Labelled reads from the text columns that the writer makes."""
    joined = t("labelled").join(t("reads").select("name", "input_order"), "name")
    start = (F.col("input_order") % 7 + 1).cast("int")
    coords = F.array(F.struct(start.alias("start"), (start + 29).alias("end"), F.lit(1).alias("rf")))
    typed = joined.select(F.col("name").alias("read_name"), coords.alias("cds_coords"), F.array(F.array(F.lit(0))).alias("cds_fragments_connection"), "rf0_labels", "rf1_labels", "rf2_labels")
    back = tables.typed_labelled_reads(sinks.as_csv_text(typed).withColumn("_c0", F.lit("0")))
    total = F.aggregate(F.filter("rf1_labels", lambda x: x.isNotNull()), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0)) + x)
    first = F.get("cds_coords", F.lit(0))
    return back.select("read_name", F.size("rf0_labels").alias("n0"), total.alias("sum1"), first["start"].alias("start"), first["rf"].alias("rf"))


@query(
    """
    with rows as (
      select testset, read_name, start, "end", rf, cast(substr(read_name, 2) as bigint) as ord, row_number() over (partition by testset, read_name order by start, "end", rf, cds_group) as idx
      from {truth})
    select concat_ws(chr(9), read_name, 'readframe', 'CDS', start, "end", '.', case when rf = 1 then '-' else '+' end, rf, concat('ID=', testset, '.', idx)) as line,
           ord as input_order, cast(case when rf = 1 then 1 else 0 end as int) as strand_rank
    from rows
    union all select '##gff-version 3', -1, 0"""
)
def gff_text(t):
    """Lines of an annotation file with what orders them."""
    idx = F.row_number().over(Window.partitionBy("testset", "read_name").orderBy("start", "end", "rf", "cds_group"))
    rows = t("truth").withColumns({"idx": idx, "input_order": F.substring("read_name", 2, 20).cast("long")})
    features = rows.select(
        F.col("read_name").alias("seqid"), F.lit("readframe").alias("source"), F.lit("CDS").alias("type"), "start", "end", F.lit(None).cast("string").alias("score"),
        F.when(F.col("rf") == 1, "-").otherwise("+").alias("strand"), F.col("rf").alias("phase"), _text("ID=", F.col("testset"), ".", F.col("idx")).alias("attributes"),
        "input_order", F.lit(0).alias("feature_rank"), "idx",
    )
    return sinks.gff_lines(features).select(F.col("value").alias("line"), "input_order", "strand_rank")


@query("select concat('>', name, chr(10), seq) as record from {reads}")
def fasta_text(t):
    """FASTA records as the writer lays them out."""
    return sinks.fasta_lines(t("reads")).select(F.col("value").alias("record"))


@query(
    """
    select concat_ws('|', name, '+', accession, concat('[[', input_order % 7 + 1, ', ', input_order % 7 + 30, ', ''1'']]'), case when input_order % 2 = 0 then '4D' else 'None' end) as header from {reads}"""
)
def labelled_headers(t):
    """Pipe headers of labelled reads."""
    start = (F.col("input_order") % 7 + 1).cast("int")
    coords = F.array(F.struct(start.alias("start"), (start + 29).alias("end"), F.lit(1).alias("rf")))
    reads = t("reads").select(
        F.col("name").alias("read_name"), F.lit("+").alias("strand"), F.col("accession").alias("assembly_id"), coords.alias("cds_coords"),
        F.when(F.col("input_order") % 2 == 0, "4D").alias("indel_positions"),
    )
    return reads.select(sinks.labelled_header().alias("header"))
