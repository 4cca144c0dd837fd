"""Sequence, annotation, prediction and genome tables derived from the test tables.

Each derivation is one SQL text that both engines run over whole tables and whole texts.  The few spellings that differ
are written as marks: ``<ALL>`` (replace every match), ``MAP(`` (transform an array), ``<x>`` (a lambda's argument),
``EACH(`` (a row for each value) and ``NUMBERED(`` (a row for each element of an array, with its place from 0).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from readframe.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
READ_LENGTH = 300
MODELS = ["small", "medium", "large"]
WINDOW_LABELS = 4

# Which base a letter of a text stands for (a..z), and which label a base stands for.
BASE_OF_LETTER = "ACGTACGTACGTACGTNCGTACGNAN"

LABEL_OF_BASE = "cast(case x when 'G' then 0 when 'N' then 3 when 'T' then 2 else 1 end as tinyint)"

DERIVED = {
    # One read per document; every letter of the text is a base.
    "raw_reads": """
        select doc_id as input_order, concat('d', doc_id) as name, upper(regexp_replace(text, '[^A-Za-z]', ''<ALL>)) as seq
        from {documents}""",
    "reads": f"""
        select doc_id as input_order, concat('d', doc_id) as name, concat('g', doc_id % 20) as accession,
               translate(lower(regexp_replace(text, '[^A-Za-z]', ''<ALL>)), 'abcdefghijklmnopqrstuvwxyz', '{BASE_OF_LETTER}') as seq
        from {{documents}}""",
    # Reads of at most 600 bases that together are the whole texts.
    "pieces": """
        select cast(input_order * 1000000 + b as bigint) as input_order, concat(name, '.', b) as name, piece as seq
        from (select input_order, name, NUMBERED(regexp_extract_all(seq, '.{{1,600}}', 0)) as (b, piece) from {reads}) p""",
    # Label arrays: the label of a codon is told by its first base.
    "labelled": f"""
        select name, accession, length(seq) as length, seq,
               MAP(regexp_extract_all(seq, '(.)..', 1), <x> {LABEL_OF_BASE}) as rf0_labels,
               MAP(regexp_extract_all(substr(seq, 2), '(.)..', 1), <x> {LABEL_OF_BASE}) as rf1_labels,
               MAP(regexp_extract_all(substr(seq, 3), '(.)..', 1), <x> {LABEL_OF_BASE}) as rf2_labels
        from {{reads}}""",
    # Truth: one CDS per line item; those with a high discount are broken by an inserted base.
    "cds_base": """
        select concat('with_errors_', case o.o_orderstatus when 'F' then '5e-06i_0.004s' when 'O' then '1.25e-05i_0.01s'
                                                            else '3.75e-05i_0.03s' end, '_300bp') as testset,
               concat('g', o.o_custkey) as accession, concat('r', l.l_orderkey) as read_name,
               concat(l.l_linenumber, '-', l.l_partkey, '-', l.l_suppkey, '-', cast(l.l_quantity as int)) as line,
               cast(l.l_linenumber % 3 as int) as rf,
               cast(l.l_linenumber % 3 + 1 + 3 * (l.l_partkey % 45) as int) as start_at,
               cast(10 + l.l_suppkey % 30 as int) as n_codons, cast(5 + l.l_suppkey % 15 as int) as n_first,
               l.l_discount > 0.08 as is_broken,
               cast(l.l_partkey * 7 + l.l_suppkey * 13 + l.l_linenumber * 5 as bigint) as mix,
               cast(l.l_quantity as int) as qty, l.l_partkey as partkey, l.l_suppkey as suppkey
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "truth": """
        select testset, accession, read_name, case when is_broken then line end as cds_group,
               cast(case part when 0 then start_at else start_at + 3 * n_first + 1 end as int) as start,
               cast(case when part = 1 then start_at + 6 * n_first when is_broken then start_at - 1 + 3 * n_first else start_at - 1 + 3 * n_codons end as int) as "end",
               cast((rf + part) % 3 as int) as rf
        from (select *, EACH(0, 1) as part from {cds_base}) p where part = 0 or is_broken""",
    # Predictions of three models: mostly right, some too long, some in the next frame, some with the break missed.
    "cds_by_model": """
        select *, (mix + case model when 'small' then 0 when 'medium' then 3 else 11 end) % 10 as kind
        from (select *, EACH('small', 'medium', 'large') as model from {cds_base}) m""",
    "pred": """
        select model, testset, accession, read_name, case when is_broken and kind <> 9 then line end as cds_group,
               cast(case when part = 1 then start_at + 3 * n_first + 1 when kind = 8 and not is_broken then start_at + 1 else start_at end as int) as start,
               cast(case when part = 1 then start_at + 6 * n_first when is_broken then start_at - 1 + 3 * n_first
                         when kind = 8 then start_at + 3 * n_codons when kind in (6, 7) then start_at - 1 + 3 * n_codons + 3 * (1 + qty % 4)
                         else start_at - 1 + 3 * n_codons end as int) as "end",
               cast(case when part = 1 or (kind = 8 and not is_broken) then (rf + 1) % 3 else rf end as int) as rf
        from (select *, EACH(0, 1) as part from {cds_by_model}) p where part = 0 or (is_broken and kind <> 9)""",
    "read_universe": """
        select concat('with_errors_', case o_orderstatus when 'F' then '5e-06i_0.004s' when 'O' then '1.25e-05i_0.01s'
                                                          else '3.75e-05i_0.03s' end, '_300bp') as testset,
               concat('g', o_custkey) as accession, concat('r', o_orderkey) as read_name, 300 as length
        from {orders}""",
    # Indel positions: one true and up to one called position per line item.
    "true_indels": "select testset, accession, read_name, cast(1 + partkey % 297 as int) as pos from {cds_base} where mix % 3 <> 0",
    "called_indels": """
        select model, testset, accession, read_name, cast(1 + (partkey + kind * 4) % 297 as int) as pos
        from {cds_by_model} where kind <> 5""",
    "genomes": """
        select concat('g', c.c_custkey) as accession, case when c.c_custkey % 3 = 0 then c.c_name end as strain,
               concat(c.c_mktsegment, ' sp', c.c_custkey % 7) as species, c.c_mktsegment as genus, n.n_name as family,
               concat('O', n.n_nationkey % 6) as "order", concat('C', n.n_nationkey % 6) as class, concat('P', r.r_regionkey) as phylum,
               r.r_name as domain, cast(20 + (c.c_custkey % 500) / cast(10 as double) as double) as gc_content,
               cast(500 + (c.c_custkey * 37) % 9000 as int) as genome_length_kb,
               cast(80 + (c.c_custkey * 13) % 1500 / cast(100 as double) as double) as coding_percentage,
               cast(400 + (c.c_custkey * 31) % 8000 as int) as protein_coding_genes,
               cast(600 + (c.c_custkey * 17) % 500 as int) as cds_median_length,
               case c.c_custkey % 10 when 0 then 'test' when 1 then 'val' else 'train' end as partition
        from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey""",
    # Aligned reads: places from orders, error strings from order keys.
    "alignments": """
        select concat('r', o_orderkey) as read_id, concat('g', o_custkey) as accession, concat('a', o_custkey % 20) as assembly_id,
               case when o_orderkey % 2 = 0 then '+' else '-' end as strand,
               cast(1 + o_orderkey * 20 + cast(floor(o_totalprice) as bigint) % 997 as bigint) as start_coordinate,
               cast(1 + o_orderkey * 20 + cast(floor(o_totalprice) as bigint) % 997 as bigint) as start,
               cast(300 + o_orderkey * 20 + cast(floor(o_totalprice) as bigint) % 997 as bigint) as "end",
               case o_orderkey % 5 when 0 then '300M'
                    when 1 then concat(10 + o_custkey % 200, 'M1I', 289 - o_custkey % 200, 'M')
                    when 2 then concat(10 + o_custkey % 200, 'M1D', 290 - o_custkey % 200, 'M')
                    when 3 then concat(10 + o_custkey % 100, 'M2I', 50 + o_custkey % 40, 'M1D', 238 - o_custkey % 100 - o_custkey % 40, 'M')
                    else concat('2I', 100 + o_custkey % 90, 'M1D', 198 - o_custkey % 90, 'M') end as cigar,
               case o_orderkey % 5 when 0 then '300'
                    when 1 then concat(5 + o_custkey % 200, 'A', 293 - o_custkey % 200)
                    when 2 then concat(10 + o_custkey % 200, '^C', 290 - o_custkey % 200)
                    when 3 then concat(60 + o_custkey % 100, '^G', 10 + o_custkey % 40, 'T0C', 226 - o_custkey % 100 - o_custkey % 40)
                    else concat('0G', 99 + o_custkey % 90, '^A', 198 - o_custkey % 90) end as md,
               concat('with_errors_', case o_orderstatus when 'F' then '5e-06i_0.004s' when 'O' then '1.25e-05i_0.01s'
                                                          else '3.75e-05i_0.03s' end, '_300bp') as dataset
        from {orders}""",
    "annotations": """
        select concat('a', l_suppkey % 20) as assembly_id, case when l_orderkey % 2 = 0 then '+' else '-' end as strand,
               cast(1 + l_orderkey * 20 + l_linenumber * 7 as bigint) as cds_start,
               cast(l_orderkey * 20 + l_linenumber * 7 + 3 * (20 + l_linenumber * 30) + case when l_quantity = 7 then 1 else 0 end as bigint) as cds_end,
               l_discount < 0.09 as certain
        from {lineitem}""",
    # Score windows: 16 codons by 4 labels per vector, four half-overlapping windows per read.
    "window_scores": """
        select concat('v', cast(floor(vec_id / 4) as bigint)) as read_name, '+' as strand, 120 as length,
               cast((vec_id % 4) * 24 as int) as window_start, embedding
        from {embeddings}""",
}


def _dialect(sql: str, spark: bool) -> str:
    if spark:
        out = sql.replace("<ALL>", "").replace("MAP(", "transform(").replace("<x>", "x ->")
        out = re.sub(r"EACH\(([^()]*)\)", r"explode(array(\1))", out)
        out = re.sub(r"NUMBERED\((.*)\) as \(", r"posexplode(\1) as (", out)
        return out.replace('"end"', "`end`").replace('"order"', "`order`")
    sql = re.sub(r"EACH\(([^()]*)\)", r"unnest([\1])", sql)
    sql = re.sub(r"NUMBERED\((.*)\) as \((\w+), (\w+)\)", r"cast(generate_subscripts(\1, 1) - 1 as int) as \2, unnest(\1) as \3", sql)
    return sql.replace("<ALL>", ", 'g'").replace("MAP(", "list_transform(").replace("<x>", "lambda x:")


def _dependencies(sql: str) -> list[str]:
    return [name for name in [*DERIVED, *TABLES] if "{" + name + "}" in sql]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived one."""
    if name in TABLES:
        scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # A text is thousands of bases long, so its work is worth dealing out.
        return spread(scan) if name == "documents" else scan
    sql = _dialect(DERIVED[name], spark=True)
    return spark.sql(sql, **{dep: table(spark, sf_dir, dep) for dep in _dependencies(sql)})


def _closure(sql: str, seen: dict[str, str]) -> None:
    for name in _dependencies(sql):
        if name in DERIVED and name not in seen:
            _closure(DERIVED[name], seen)
            seen[name] = DERIVED[name].replace("{{", "{").replace("}}", "}")


def oracle(sql: str, recursive: bool = False) -> str:
    """Plain SQL over the test tables: the derived tables a query names in braces become common table expressions.

    A query text that starts with ``with`` goes on with further ones.
    """
    needed: dict[str, str] = {}
    _closure(sql, needed)
    body = sql.strip()
    parts = [f"{name} as ({text})" for name, text in needed.items()]
    own = body[5:].lstrip() if body[:5].lower() == "with " else None
    head = ("with recursive " if recursive else "with ") if parts or own else ""
    text = head + ", ".join(parts) + (", " if parts and own else " " if parts else "") + (own if own is not None else body)
    for name in [*DERIVED, *TABLES]:
        text = text.replace("{" + name + "}", name)
    return _dialect(text, spark=False)
