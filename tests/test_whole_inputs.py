"""Nothing is lost to depth, length, key or missing metadata."""

import numpy as np
import pytest

from readframe.operators import datasets, evaluate, intervals, scan, stats, taxonomy
from readframe.plans import labelled_reads


def test_lineages_are_as_deep_as_the_tree(spark):
    chain = [(f"t{k}", f"t{k - 1}" if k else "2", "no rank") for k in range(100)] + [("2", "1", "domain"), ("1", "1", "no rank"), ("lone", "gone", "genus")]
    nodes = spark.createDataFrame(chain, "tax_id string, parent_id string, rank string")
    names = nodes.selectExpr("tax_id", "concat('name of ', tax_id) as name")
    taxa = spark.createDataFrame([("a", "t99"), ("b", "t0"), ("c", "1"), ("d", "lone")], "accession string, tax_id string")
    rows = taxonomy.lineages(taxa, nodes, names).collect()
    assert sorted((r.depth, r.tax_id) for r in rows if r.accession == "a") == [(k, f"t{99 - k}") for k in range(100)] + [(100, "2")]
    assert {r.accession for r in rows} == {"a", "b"} and sum(r.accession == "b" for r in rows) == 2


def test_a_cycle_in_the_taxonomy_is_an_error(spark):
    nodes = spark.createDataFrame([("x", "y", "r"), ("y", "z", "r"), ("z", "x", "r"), ("2", "1", "domain")], "tax_id string, parent_id string, rank string")
    taxa = spark.createDataFrame([("a", "x")], "accession string, tax_id string")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.lineages(taxa, nodes, nodes.selectExpr("tax_id", "tax_id as name"))


def test_label_classes_take_frames_of_any_length(spark):
    reads = spark.createDataFrame([([1, 1, 1], [0, 0, 0], [2, 2]), ([3], [], [])], "rf0_labels array<tinyint>, rf1_labels array<tinyint>, rf2_labels array<tinyint>")
    assert [tuple(r) for r in datasets.label_classes(reads).collect()] == [(0, 1, 0, 2)]


def test_an_accession_in_two_lists_belongs_to_the_later(spark):
    genomes = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    lists = {"train": spark.createDataFrame([("a",), ("b",)], "accession string"), "test": spark.createDataFrame([("b",)], "accession string")}
    got = {r.accession: r.partition for r in datasets.partition_label(genomes, lists).collect()}
    assert got == {"a": "train", "b": "test", "c": "none"}


def test_genomes_without_metadata_stay_in_the_totals(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "accession string, tp int")
    genomes = spark.createDataFrame([("a", "f", "Bacteria", 45.0)], "accession string, family string, domain string, gc_content double")
    got = {r.accession: (r.tp, r.gc_bin) for r in evaluate.with_genome_info(counts, genomes).collect()}
    assert set(got) == {"a", "b"} and got["b"] == (2, None)


def test_best_rows_of_a_null_group_are_marked(spark):
    scores = spark.createDataFrame([(None, 0.1), (None, 0.4), ("x", 0.2)], "k string, f1 double")
    assert sorted((r.f1, r.is_best) for r in evaluate.mark_best(scores, ["k"], "f1").collect()) == [(0.1, False), (0.2, True), (0.4, True)]


def test_quantiles_and_ranks_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"a": np.round(1 - rng.exponential(0.01, 500), 4), None: rng.normal(size=7), "one": np.array([0.5])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.low, r.mid) for r in scan.exact_quantiles(df, ["k"], "v", {"low": 0.25, "mid": 0.5}, slices=8).collect()}
    for key, vs in values.items():
        assert got[key] == pytest.approx((np.quantile(vs, 0.25), np.median(vs)))
    ranks = scan.average_ranks(df, ["k"], "v", "r", slices=8).collect()
    assert len(ranks) == len(rows)
    for r in ranks:
        vs = values[r.k]
        assert r.r is None if r.v is None else r.r == (vs < r.v).sum() + ((vs == r.v).sum() + 1) / 2
    box = {r.k: r for r in stats.box_numbers(df, ["k"], "v").collect()}
    low, high = np.quantile(values["a"], [0.25, 0.75])
    inside = [v for v in values["a"] if low - 1.5 * (high - low) <= v <= high + 1.5 * (high - low)]
    assert (box["a"].whisker_low, box["a"].whisker_high, box["a"].n) == (min(inside), max(inside), 500) and box[None].whisker_high is not None


def test_reads_longer_than_a_chunk_meet_the_reference(spark):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 300))
    sequences = spark.createDataFrame([("a", "+", seq)], "assembly_id string, strand string, seq string")
    reads = [("a", "+", s + 1, seq[s : s + 90]) for s in range(0, 300, 7)] + [("a", "+", 1, "T" + seq[1:60] if seq[0] != "T" else "A" + seq[1:60])]
    df = spark.createDataFrame(reads, "assembly_id string, strand string, start long, restored string")
    got = intervals.matches_reference(df, intervals.chunk_sequences(sequences, overlap=90, width=16), width=16).collect()
    assert sorted(r.is_restored for r in got) == [False] + [True] * (len(reads) - 1)


def test_equal_read_ids_of_two_genomes_are_two_reads(spark):
    rng = np.random.default_rng(4)
    body = "".join(rng.choice(["GCT", "GAC", "CGA", "CAC"], 40))
    seq = "ATG" + body + "TAA" + "".join(rng.choice(list("ACGT"), 40))
    read = seq[:90]
    rows = [(acc, f"{acc}-asm", "+", "r1", 1, "90M", read, "90") for acc in ("g", "h")]
    alignments = spark.createDataFrame(rows, "accession string, assembly_id string, strand string, read_id string, start_coordinate int, cigar string, read string, md string")
    annotations = spark.createDataFrame([(f"{acc}-asm", "+", 1, 126, True) for acc in ("g", "h")], "assembly_id string, strand string, cds_start long, cds_end long, certain boolean")
    assemblies = spark.createDataFrame([(f"{acc}-asm", "+", seq) for acc in ("g", "h")], "assembly_id string, strand string, seq string")
    table = {"GCT": "A", "GAC": "D", "CGA": "R", "CAC": "H"}
    protein = "M" + "".join(table[body[k : k + 3]] for k in range(0, len(body), 3))
    proteins = spark.createDataFrame([("g", protein), ("h", "QQQQQQQQQQ")], "accession string, protein string")
    got = labelled_reads.check_reads(alignments, annotations, assemblies, proteins, 90).collect()
    assert sorted((r.accession, r.kept) for r in got) == [("g", True), ("h", False)]


def test_reads_of_a_hot_bin_are_split(spark):
    """Nine reads in ten start in one bin: the plan lets adaptive execution split them, and each finds its CDSs."""
    reads = spark.range(2000).selectExpr("id as read_id", "'a' as assembly_id", "'+' as strand", "if(id % 10 = 0, id * 900, 100 + id % 50) as start").selectExpr("*", "start + 89 as end")
    cds = spark.createDataFrame([("a", "+", 120, 400), ("a", "+", 90_000, 90_500), ("b", "+", 1, 10_000)], "assembly_id string, strand string, cds_start long, cds_end long")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = intervals.attach_cds(reads, cds, 90)
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plan and len(rows) == 2000
    for r in rows:
        assert [(c.start, c.end) for c in r.cds] == [(s, e) for s, e in ((120, 400), (90_000, 90_500)) if s <= r.end and e >= r.start]
