"""What must not grow faster than the input: passes over it, groupings, tasks that hold most rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from readframe.functions import errors as E
from readframe.functions import labels as L
from readframe.functions import metrics as M
from readframe.functions import sequence as S
from readframe.functions.draws import threshold
from readframe.operators import datasets as DS
from readframe.operators import evaluate as V
from readframe.operators import intervals as I
from readframe.operators import stats as T
from readframe.queries import alignments
from readframe.queries.catalog import QUERIES
from readframe.session import measured, spread
from readframe.sources import gff

SPANS = "testset string, accession string, read_name string, cds_group string, start int, end int, rf int"
TRUTH = [("t", "g", "r1", None, 1, 30, 0), ("t", "g", "r1", None, 1, 30, 0), ("t", "g", "r1", "a", 40, 60, 0), ("t", "g", "r1", "a", 62, 90, 1), ("t", "g", None, "b", 4, 9, 0)]
PRED = [("m", *row) for row in TRUTH[:4]] + [("m", "t", "g", "r2", None, 5, 10, 1), ("n", "t", "g", "r1", None, 1, 30, 0)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def spans(spark):
    return spark.createDataFrame(TRUTH, SPANS), spark.createDataFrame(PRED, "model string, " + SPANS)


@pytest.fixture()
def counted(spark):
    """Rows as a table that counts how often it is made."""
    seen = spark.sparkContext.accumulator(0)

    def make(rows, schema):
        def note(row):
            seen.add(1)
            return row

        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(note), schema)

    return make, seen


def test_unbroken_cdss_are_not_grouped(spark):
    _, pred = spans(spark)
    whole = V.whole_cds(pred, V.READ)
    assert sorted((r.model, r.read_name, r.start, r.end, -1 if r.rf is None else r.rf, len(r.fragments)) for r in whole.collect()) == [
        ("m", "r1", 1, 30, 0, 1), ("m", "r1", 1, 30, 0, 1), ("m", "r1", 40, 90, -1, 2), ("m", "r2", 5, 10, 1, 1), ("n", "r1", 1, 30, 0, 1),
    ]
    # The fragments of broken CDSs alone are grouped, and the hash is what the grouping sorts by first.
    assert "xxhash64" in plan(whole) and "count(1)" not in plan(whole)


def test_codon_words_of_all_models_are_one_group(spark):
    truth, pred = spans(spark)
    reads = spark.createDataFrame([("t", "g", "r1", 300), ("t", "g", "r2", 300)], "testset string, accession string, read_name string, length int")
    whole = V.whole_cds(truth, V.READ[1:]), V.whole_cds(pred, V.READ)
    counts = V.codon_confusion(*whole, reads, ["m", "n", "none"])
    assert {r.model: (r.tp, r.fp, r.fn, r.tn) for r in counts.collect()} == {"m": (26, 2, 0, 566), "n": (10, 0, 16, 568), "none": (0, 0, 26, 568)}
    assert "keys=[model" not in plan(counts)


def test_easy_and_hard_reads_are_made_once(spark):
    truth, pred = spans(spark)
    whole = V.for_models(V.whole_cds(truth, V.READ[1:]), ["m", "n"]), V.whole_cds(pred, V.READ)
    matched = V.iou_match_counts(*whole, 0.8, ["model"])
    assert sorted(map(tuple, matched.collect())) == [("m", 3, 1, 1), ("n", 1, 0, 3)]
    assert plan(matched).count("collect_list(CASE") == 4  # two sides, before and after they meet
    places = "model string, testset string, accession string, read_name string, pos int"
    true = spark.createDataFrame([("m", "t", "g", "r", p) for p in (5, 20)] + [("m", "t", "g", "s", 9)], places)
    called = spark.createDataFrame([("m", "t", "g", "r", p) for p in (7, 21, 40)] + [("m", "t", "g", "s", 4)], places)
    found = V.indel_matches(true, called)
    assert sorted((r.read_name, r.tp, r.distance, r.side) for r in found.collect()) == [("r", 2, 3, "both"), ("s", 1, 5, "both")]
    assert plan(found).count("Exchange hashpartitioning") == 1


def test_reports_make_their_scores_once(counted):
    make, seen = counted
    rows = [("m", f"g{i}", f"f{i % 2}", float(i), i, 1, 2) for i in range(20)] + [("n", "g0", "f0", 0.0, 1, 1, 1)]
    scores = make(rows, "model string, accession string, family string, gc double, tp long, fp long, fn long")
    makers = [
        lambda: T.box_numbers(M.with_scores(scores), ["model"], "f1"),
        lambda: T.spearman(M.with_scores(scores), ["model"], "gc", "f1"),
        lambda: V.family_report(scores, M.f1, 2, "m"),
    ]
    for number, report in enumerate(makers, 1):
        assert report().count() and seen.value == number * len(rows)


def test_coins_go_to_a_named_number_of_tasks(spark):
    counts = spark.createDataFrame([(m, "t", f"g{g}", "r", 1, 0, k) for k, m in enumerate("ab") for g in range(6)], "model string, testset string, accession string, read_name string, tp long, fp long, fn long")
    assert "REPARTITION_BY_NUM" in plan(T.permutation_test(counts, ["a", "b"], n_permutations=10))


@pytest.mark.parametrize("name", ["padded_labels", "token_ids"])
def test_texts_are_not_dealt_out_by_genome(spark, tmp_path, name):
    rows = [(1, "ACGTTGAGA"), (21, "ACG"), (2, "ATGCAAAA"), (None, "AC"), (41, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        padded = QUERIES[name](spark, str(tmp_path))
        assert "hashpartitioning(accession" not in plan(padded)
        assert sorted(r.name for r in padded.collect()) == ["d1", "d2", "d21", "d41"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_table_is_not_sent_to_all_tasks(spark):
    small, large = spark.range(10), spark.range(10)
    assert "broadcast" in measured(small, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in measured(large, 9)._jdf.queryExecution().logical().toString()


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(10_000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(f"{tmp_path}/rows")
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        scan = spark.read.parquet(f"{tmp_path}/rows")
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(scan).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in dealt) == 10_000
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_annotations_are_made_and_cut_once(spark, counted):
    make, seen = counted
    rows = [("a", "+", 1, 30, True), ("a", "+", 1, 60, True), ("a", "+", 7, 60, True), ("a", "+", 1, 30, False), ("a", "-", 5, 9, False), ("a", "-", 5, 9, False)]
    rows += [("a", "-", 2, 8, True), ("a", "-", 2, 8, False), ("b", None, 4, 6, True), ("b", "+", 4, 6, None), ("b", "+", 4, None, False), ("b", "+", 8, None, True)]
    checked = I.check_annotations(make(rows, "assembly_id string, strand string, cds_start long, cds_end long, certain boolean"))
    wanted = [("a", "+", 1, 60, True), ("a", "+", 1, 30, False), ("a", "-", 5, 9, False), ("a", "-", 2, 8, False), ("b", None, 4, 6, True), ("b", "+", 4, None, False), ("b", "+", 8, None, None)]
    assert sorted(map(str, checked.collect())) == sorted(str(r) for r in spark.createDataFrame(wanted, checked.schema).collect())
    assert seen.value == len(rows)
    lines = spark.createDataFrame([("x\ts\tCDS\t1\t9\t.\t-\t0\tID=1",), ("#x\ts\tCDS\t1\t9\t.\t-\t0\tID=1",), ("x\ty",), ("",), (None,)], "value string")
    parsed = gff.parse_gff(lines).filter("type = 'CDS' and strand in ('+', '-') and start < 5")
    assert plan(parsed).count("split(") == 1 and parsed.count() == 1
    lengths = spark.createDataFrame([("a", 100), ("b", 50)], "assembly_id string, length int")
    turned = I.flip_minus_strand(checked, lengths.groupBy("assembly_id").agg(F.max("length").alias("length")))
    assert "BroadcastHashJoin" in plan(turned) and turned.filter("cds_start = 92 and cds_end = 96").count() == 1


def test_places_of_cds_do_not_carry_texts(spark, tmp_path, monkeypatch):
    from readframe.queries import genomes

    text = "acgt" * 30
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    records = QUERIES["cds_records"](spark, str(tmp_path)).collect()
    assert len(records) == 3 * 4 + 3 and all(r.protein for r in records if len(r.cds_seq) > 2)
    monkeypatch.setattr(genomes.CR, "cds_records", lambda places, reads: places)
    made = [line for line in plan(QUERIES["cds_records"](spark, str(tmp_path))).splitlines() if "Generate explode" in line]
    assert len(made) == 4 and not any("seq#" in line for line in made)


def test_residues_of_odd_codons(spark):
    rows = [("TTTATGTAANNNT TTT ÄÄÄttt",), ("AC",), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(S.translate_protein(F.col("s")).alias("p"), S.translate_model(F.col("s")).alias("m"), S.translate_protein(F.col("s")).alias("q"))
    assert [(r.p, r.m) for r in got.collect()] == [("FM*XXXXF", "FMX" + "<unk>" * 5), ("", ""), ("", ""), (None, None)]
    assert plan(got).count("substring") == 0


def test_masking_names_the_row_once(spark):
    reads = spark.createDataFrame([("ACGTN" * 40, "a"), ("AC" * 50, None), ("", "b"), (None, "c")], "seq string, name string")
    masked = reads.select("seq", "name", S.mask_bases(F.col("seq"), F.col("name"), 42, 300_000).alias("m"))
    for r in masked.collect():
        drawn = lambda i: hashlib.md5(":".join(["42", *([r.name] if r.name else []), str(i)]).encode()).hexdigest()[:8]
        assert r.m == (None if r.seq is None else "".join("N" if drawn(i) < threshold(0.3) else x for i, x in enumerate(r.seq)))
    assert "concat_ws(:, 42, name" in plan(masked)


def test_triples_are_distinct_numbers(spark):
    rows = [([0, 1, 1, None], [0, -1, -1, 5], [2, 127, 127, -128, 9]), ([], [1], [1]), (None, [1], [1])]
    reads = spark.createDataFrame(rows, ", ".join(f"{c} array<tinyint>" for c in DS.LABELS))
    triples = DS.label_triples(reads)
    assert [f.dataType.typeName() for f in triples.schema] == ["byte"] * 3
    assert sorted(map(str, map(tuple, triples.collect()))) == sorted(map(str, [(0, 0, 2), (1, -1, 127), (None, 5, -128)]))
    assert "arrays_zip" in plan(triples) and "size(array_distinct" not in plan(triples) and "array_distinct(transform" in plan(triples)


def test_frames_are_labelled_once(spark):
    rows = [("r", 10, [(4, 33), (1, 12)], "20M1I9M"), ("s", 10, [], "30M"), ("t", 10, [(10, 39)], "9M")]
    reads = spark.createDataFrame(rows, "read_id string, start long, cds array<struct<start:long,end:long>>, cigar string").withColumn("ops", E.parse_cigar(F.col("cigar")))
    nt = lambda rf: L.nt_labels_with_indels(F.col("start"), F.lit(30), F.col("cds"), F.col("ops"), rf)
    found = alignments._nonzero(reads, lambda rf: L.codon_labels(nt(rf)))
    assert "size(transform(" not in plan(found) and plan(L_only := reads.select(L.codon_labels(nt(0)).alias("x"))).count("flatten(") == 1
    assert sorted((r.read_id, r.rf, r.codon, r.label) for r in found.collect() if r.read_id == "r") == [
        ("r", 0, 0, 3), *[("r", 0, i, 1) for i in range(1, 6)], ("r", 1, 7, 3),
    ]
    assert [r.x for r in L_only.collect()][1:] == [[0] * 10, None]


def test_checked_annotations_come_in_a_named_number_of_tasks(spark):
    rows = spark.createDataFrame([("a", "+", 3 * i, 3 * i + 2, True) for i in range(50)], "assembly_id string, strand string, cds_start long, cds_end long, certain boolean")
    checked = I.check_annotations(rows)
    assert checked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and checked.count() == 50
    assert plan(checked).count("Exchange hashpartitioning") == 2


def scattered(spark):
    """Truth and predictions with copies, chains, a read and a genome of one side only, null keys and a model without calls."""
    truth = [("t", g, f"r{i % 9}", f"c{i % 4}" if i % 3 == 0 else None, 1 + 3 * (i % 7), 30 + 3 * (i % 5), i % 3) for i in range(60) for g in ("g1", "g2")]
    truth += [("t", "g3", "r1", None, 1, 30, 0), ("t", None, "r1", None, 1, 30, 0), ("t", "g1", None, None, 4, 33, 1), ("t", "g1", "r1", None, None, 33, None)]
    pred = [(m, *row[:-2], row[-2] + 3 * (k % 2 == i), row[-1]) for i, m in enumerate("ab") for k, row in enumerate(truth) if k % (5 + i)]
    pred += [("a", "t", "g4", "r1", None, 1, 30, 0)]
    pred = [tuple(row) for row in pred if row[6] is not None]
    return spark.createDataFrame(truth, SPANS), spark.createDataFrame(pred, "model string, " + SPANS), ["a", "b", "none"]


def test_models_side_by_side_count_as_one_by_one(spark):
    truth, pred, models = scattered(spark)
    ours, theirs = V.whole_cds(truth, V.READ[1:]), V.whole_cds(pred, V.READ)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    for keys in (V.READ, V.GENOME, ["testset", "model"]):
        found = V.exact_match_counts_by_model(ours, theirs, models, keys)
        assert found.columns == [*keys, "tp", "fp", "fn"]
        assert rows(found) == rows(V.exact_match_counts(V.for_models(ours, models), theirs, keys))
    edges = V.boundary_counts_by_model(ours, theirs, models, F.lit(300))
    assert rows(edges) == rows(V.boundary_counts(V.for_models(ours, models), theirs, F.lit(300)).select(edges.columns))


def test_the_truth_is_not_repeated_for_each_model(spark, tmp_path):
    """A row of a place holds all models, and the counts of a read are put side by side without sorting the reads."""
    for name in ("exact_match_metrics", "start_stop_detection", "gc_rank_correlation", "ablation_sweep"):
        assert name in QUERIES
    truth, pred, models = scattered(spark)
    found = V.exact_match_counts_by_model(V.whole_cds(truth, V.READ[1:]), V.whole_cds(pred, V.READ), models)
    assert "explode(array(a, b, none))" not in plan(found) and "_p2" in plan(found)
    counts = spark.createDataFrame([(m, "t", f"g{i}", "r", 1, 0, i) for m in "ab" for i in range(6)] + [("a", "t", "g1", "s", 2, 2, 2)], "model string, testset string, accession string, read_name string, tp long, fp long, fn long")
    vectors = T._pair_counts(counts, ["a", "b"], 5)
    assert sorted((tuple(r.a), tuple(r.b), r.n) for r in vectors.collect()) == sorted([((1, 0, i), (1, 0, i), 1) for i in range(6)] + [((2, 2, 2), (0, 0, 0), 1)])


def test_counts_of_a_read_need_no_sort(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(T, "checkpointed", lambda df: kept.append(plan(df)) or df)
    counts = spark.createDataFrame([("a", "t", "g", "r", 1, 0, 0)], "model string, testset string, accession string, read_name string, tp long, fp long, fn long")
    T._pair_counts(counts, ["a", "b"], 1)
    assert "SortAggregate" not in kept[0] and "HashAggregate" in kept[0]
