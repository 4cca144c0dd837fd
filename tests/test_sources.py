"""Text formats in and out."""

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from readframe.operators import decode
from readframe.plans import annotations, cds_records, scoring, truth_sets
from readframe.sources import fasta, gff, sinks, tables


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_fasta_plain_and_gzip(spark, tmp_path):
    text = ">r1 first read\nacgt\nAC GT\r\n\n>r2\nTTT\n>r3\n"
    (tmp_path / "a.fasta").write_text(text)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(text)
    for name in ("a.fasta", "b.fasta.gz"):
        got = fasta.read_fasta(spark, str(tmp_path / name)).orderBy("input_order").collect()
        assert [(r.name, r.seq) for r in got] == [("r1", "ACGTACGT"), ("r2", "TTT"), ("r3", "")]


def test_labelled_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">r1|+|NC_1|[[1, 30, '0'], [32, 61, '1']]|31I\nACGT\n>r2|-\nGG\n")
    got = {r.read_name: r for r in fasta.read_labelled_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert [tuple(c) for c in got["r1"].cds_coords] == [(1, 30, 0), (32, 61, 1)] and got["r1"].indel_positions == "31I"
    assert got["r2"].cds_coords == [] and got["r2"].indel_positions is None and got["r2"].assembly_id is None
    header = fasta.read_labelled_fasta(spark, str(tmp_path / "x.fasta")).filter("read_name = 'r1'").select(sinks.labelled_header()).first()[0]
    assert header == "r1|+|NC_1|[[1, 30, '0'], [32, 61, '1']]|31I"


def test_labelled_reads_csv_round_trip(spark, tmp_path):
    labels = [0, 2, 1]
    row = ("r1", "ACGTACGTAC", [(1, 9, 0)], [[0]], 5, "NC_1", "10M", "10", None, "g1", "TYV", labels, "RT", labels, "VR", labels, "+")
    schema = (
        "read_name string, read string, cds_coords array<struct<start:int,end:int,rf:int>>, cds_fragments_connection array<array<int>>, start_coord int, "
        "assembly_id string, CIGAR string, MD string, indel_positions string, accession string, rf0_seq string, rf0_labels array<tinyint>, rf1_seq string, "
        "rf1_labels array<tinyint>, rf2_seq string, rf2_labels array<tinyint>, strand string"
    )
    reads = spark.createDataFrame([row], schema)
    frame = sinks.as_csv_text(reads).toPandas()
    frame.to_csv(tmp_path / "g1.csv.gz")
    back = tables.read_labelled_reads(spark, str(tmp_path / "g1.csv.gz"))
    assert back.first().asDict(recursive=True) == reads.first().asDict(recursive=True)
    sinks.write_labelled_reads(reads, str(tmp_path / "out"))
    assert (tmp_path / "out" / "csv" / "genome=g1").is_dir() and (tmp_path / "out" / "fasta" / "accession=g1").is_dir()


GFF = """##gff-version 3
##species https://example.org/taxonomy?id=562
NC_1\tX\tCDS\t10\t39\t.\t+\t0\tID=a;product=kinase
NC_1\tX\tCDS\t50\t79\t.\t-\t0\tID=b;Note=x=y;pseudo=true
NC_1\tX\tgene\t50\t79\t.\t-\t0\tID=c
broken line
r1\tX\tCDS\t1\t30\t.\t+\t0\tID=r1_group+_1;group_id=group_1.0;indel_type=insertion
r1\tX\tCDS\t32\t61\t.\t+\t1\tID=r1_group+_1;group_id=group_1.1;indel_type=insertion
r1\tX\tCDS\t70\t99\t.\t+\t0\tID=r1_CDS+_1
"""


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    table = gff.read_gff(spark, str(tmp_path / "a.gff"))
    assert table.count() == 6
    maps = {r.m["ID"]: r.m for r in table.select(gff.attribute_map(F.col("attributes")).alias("m")).collect()}
    assert maps["b"]["Note"] == "x=y"
    called = {(r.start, r.cds_group, r.rf) for r in gff.called_cds(table.filter("seqid = 'r1'")).collect()}
    assert called == {(1, "+:group_1", 0), (32, "+:group_1", 1), (70, None, 0)}
    assert {r.rf for r in gff.gene_caller_cds(table).filter("start = 10").collect()} == {0}
    assert gff.species_taxa(spark, str(tmp_path / "a.gff")).first().tax_id == "562"


def test_build_annotations(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    first = gff.read_gff(spark, str(tmp_path / "a.gff")).filter("seqid = 'NC_1'").withColumn("accession", F.lit("g"))
    second = first.withColumns({"seqid": F.lit("CP_1"), "end": F.col("end") + 30})
    records = spark.createDataFrame([("g", 0, 1, "NC_1", 1000), ("g", 1, 2, "CP_1", 1000)], "accession string, source_rank int, ordinal int, name string, length int")
    lengths = spark.createDataFrame([("NC_1", 1000)], "assembly_id string, length int")
    got = {tuple(r) for r in annotations.build_annotations(first, second, records, lengths).collect()}
    assert got == {("NC_1", "+", 10, 69, True), ("NC_1", "-", 922, 951, False), ("NC_1", "-", 892, 951, False)}


def test_caller_out_alignments_taxonomy_lists(spark, tmp_path):
    (tmp_path / "c.out").write_text(">r1|+|x\n1\t297\t+\t1\t1.3\tI:\tD:\n5\t90\t-\t2\t1.3\tI:\tD:\n>r2\n2\t61\t+\t2\t1.2\tI:20,\tD:41,\n>r3\n")
    calls = tables.read_caller_out(spark, str(tmp_path / "c.out"), 300).collect()
    assert [(c.start, c.end, c.rf) for c in calls if c.read_name == "r1"] == [(1, 300, 0)]
    assert sorted((c.start, c.end, c.rf) for c in calls if c.read_name == "r2") == [(2, 19, 1), (21, 38, 2), (41, 61, 1)]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t0\tNC_1\t7\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tMD:Z:4\nq2\t16\tNC_1\t9\t60\t*\t*\t0\t0\tACGT\tIIII\n")
    sam = tables.read_alignments(spark, str(tmp_path / "a.sam"))
    rows = {r.read_id: r for r in sam.collect()}
    assert (rows["q1"].start_coordinate, rows["q1"].md, rows["q2"].md, rows["q2"].cigar) == (7, "4", None, None)
    assert [r.read_id for r in tables.forward_only(sam).collect()] == ["q1"]
    (tmp_path / "nodes.dmp").write_text("562\t|\t561\t|\tspecies\t|\n")
    (tmp_path / "names.dmp").write_text("562\t|\tE. coli\t|\t\t|\tscientific name\t|\n562\t|\tcolon\t|\t\t|\tsynonym\t|\n")
    assert tuple(tables.read_tax_nodes(spark, str(tmp_path / "nodes.dmp")).first()) == ("562", "561", "species")
    assert [tuple(r) for r in tables.read_tax_names(spark, str(tmp_path / "names.dmp")).collect()] == [("562", "E. coli")]
    listed = spark.createDataFrame([("b",), ("a",)], "accession string")
    sinks.write_accessions(listed, str(tmp_path / "list"))
    assert [r.accession for r in tables.read_accessions(spark, str(tmp_path / "list")).collect()] == ["a", "b"]


CLASSES = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (4, 0, 0), (5, 0, 0), (0, 4, 0), (2, 0, 0), (3, 0, 0), (0, 3, 0)]


def scripted(path):
    """A scorer that favours one given class per codon."""

    def score(batches):
        for batch in batches:
            out = batch[["read_name", "strand", "length", "window_start"]].copy()
            scores = []
            for r in batch.itertuples():
                codons = len(r.window_seq) // 3
                wanted = path if r.strand == "+" else [0] * 1000
                at = r.window_start // 3
                scores.append([list(np.eye(len(CLASSES), dtype=np.float32)[wanted[at + c]] * 50) for c in range(codons)])
            out["scores"] = scores
            yield pd.DataFrame(out)

    return score


def test_reads_to_gff_and_records(spark, tmp_path):
    # Start at codon 2, an insertion after codon 12, on in frame 1 from codon 14, stop at codon 30.
    path = [0, 0, 6] + [1] * 9 + [4 + 0] + [0] + [5] + [2] * 15 + [8] + [0] * 200
    seq = ("ACGTTGCAAG" * 13)[:120]
    reads = spark.createDataFrame([(0, "r1", seq)], "input_order long, name string, seq string")
    called = scoring.call_reads(reads, scripted(path), CLASSES, decode.transition_scores(CLASSES, -0.5))
    features = scoring.gff_features(called, reads.select(F.col("name").alias("read_name"), "input_order"), involved_groups=True)
    sinks.write_gff(features, str(tmp_path / "gff"))
    got = [line.split("\t") for line in lines(tmp_path / "gff")]
    assert got[0] == ["##gff-version 3"]
    assert [(f[2], f[3], f[4], f[7]) for f in got[1:]] == [
        ("CDS", "7", "39", "0"), ("CDS", "44", "94", "1"), ("start_codon", "7", "9", "."), ("stop_codon", "92", "94", "."), ("uncertain_region", "40", "43", "."),
    ]
    assert got[1][8] == "ID=r1_group+_1;start=start_codon;end=indel_stop;group_id=group_1.0;indel_type=insertion"
    assert got[5][8] == "Note=Uncertain region: Frameshift gap between RF0 and RF1;overlapping_frames=0,1"
    table = gff.read_gff(spark, str(tmp_path / "gff")).withColumn("line", F.monotonically_increasing_id())
    records = cds_records.cds_records(table, reads.select("name", "seq"))
    sinks.write_cds_records(records, str(tmp_path / "cds"), formats=("fna",))
    assert lines(tmp_path / "cds.fna") == [">r1_group+_1", seq[6:39] + seq[43:94]]
    assert not (tmp_path / "cds.faa").exists()


def test_chains_from_index_lists(spark):
    df = spark.createDataFrame([([(1, 30, 0), (32, 61, 1), (80, 99, 0)], [[0, 1], [2]])], "c array<struct<start:int,end:int,rf:int>>, g array<array<int>>")
    got = df.select(truth_sets.grouped_coordinates(F.col("c"), F.col("g"))).first()[0]
    assert [r.cds_group for r in got] == [0, 0, 1]


def test_truth_and_prediction_tiers(spark):
    coords = "array<struct<start:int,end:int,rf:int,cds_group:int>>"
    reads = spark.createDataFrame([("t", "g", "r", [(1, 30, 0, 0), (32, 64, 1, 0), (100, 132, 0, 1), (200, 229, 1, 2)], "31I,110D")], f"testset string, accession string, read_name string, cds_coords {coords}, indel_positions string")
    tiers = truth_sets.truth_cds(reads)
    assert sorted((r.tier, r.cds_group, r.indels) for r in tiers.collect()) == [("main", 0, ["31I"]), ("wide", 0, ["31I"]), ("wide", 1, ["110D"])]
    assert sorted((r.start, r.cds_group) for r in truth_sets.as_cds_table(tiers, "main").collect()) == [(1, "0"), (32, "0")]
    pred = spark.createDataFrame(
        [("m", "t", "g", "r", "x", 1, 30, 0), ("m", "t", "g", "r", "x", 35, 61, 1), ("m", "t", "g", "r", None, 1, 30, 0), ("m", "t", "g", "r", "y", 100, 114, 0), ("m", "t", "g", "r", "y", 116, 130, 1)],
        "model string, testset string, accession string, read_name string, cds_group string, start int, end int, rf int",
    )
    found = truth_sets.predicted_cds(pred)
    assert sorted((r.tier, r.cds_group or "", r.indels) for r in found.collect()) == [("wide", "", []), ("wide", "x", ["32I"])]
    assert [(r.pos, r.kind) for r in truth_sets.indel_positions(found, "wide").collect()] == [(32, "I")]
