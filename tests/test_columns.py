"""Hand cases for column expressions."""

import random

from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions import errors as E
from readframe.functions import labels as L
from readframe.functions import sequence as S
from readframe.operators import windows as W
from readframe.sources import fasta


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_translate_and_reverse(spark):
    got = values(
        spark, [("ATGGCC",), ("ATGTAA",), ("ATGNCC",), ("ATGGCCA",), ("atgtaa",)], "s string",
        S.translate_protein(F.col("s")), S.translate_model(F.upper("s")), S.reverse_complement(F.col("s")),
    )
    assert [g[0] for g in got] == ["MA", "M*", "MX", "MA", "M*"]
    assert [g[1] for g in got] == ["MA", "MX", "M<unk>", "MA", "MX"]
    assert [g[2] for g in got] == ["GGCCAT", "TTACAT", "GGNCAT", "TGGCCAT", "ttacat"]


def test_clean_keeps_iupac_unless_a_bad_letter_is_there(spark):
    base = "ACGT" * 8
    rows = [(1, "a", base + "R"), (2, "b", base + "RJ"), (3, "c", "A" * 29), (4, "d", "U" * 30)]
    reads = spark.createDataFrame(rows, "input_order long, name string, seq string")
    assert {r.name: r.seq for r in fasta.clean(reads).collect()} == {"a": base + "R", "b": base + "NN", "d": "T" * 30}
    assert {r.name: r.reason for r in fasta.rejects(reads).collect()} == {"b": "non-standard letters", "c": "too short"}
    assert {r.name: r.seq for r in fasta.clean(reads, strict=True).collect()}["a"] == base + "N"


def test_windows_cover_every_codon(spark):
    got = values(spark, [(n,) for n in (1, 299, 300, 301, 303, 450, 700)], "n int", F.col("n"), W.window_starts(F.col("n")))
    starts = dict(got)
    assert starts[300] == [0] and starts[301] == [0] and starts[303] == [0, 3]
    assert starts[450] == [0, 150] and starts[700] == [0, 150, 300, 399]
    for n, at in got:
        covered = {c for s in at for c in range(s // 3, (s + 300) // 3)}
        assert set(range(n // 3)) <= covered


def test_errors_from_md(spark):
    cases = {
        ("10A289", "300M"): "11A",
        ("10^A290", "10M1D290M"): "11D",
        ("10A5^AC3T2", "300M"): "11A,17D,22T",
        ("299", "20M1I279M"): "21I",
        ("300", "300M"): "",
        ("20^A0^C280", "300M"): "21D,21D",
    }
    insertions = L.insertion_positions(E.parse_cigar(F.col("c")))
    got = values(spark, list(cases), "md string, c string", E.error_string(E.errors_from_md(F.col("md"), F.lit(300), insertions)))
    assert [g[0] for g in got] == list(cases.values())


def test_shift_drops_the_second_of_neighbouring_deletions(spark):
    rows = [([(10, "I"), (20, "A")],), ([(20, "A"), (10, "D"), (11, "D")],), ([(10, "D"), (10, "G"), (11, "D")],)]
    got = values(spark, rows, "e array<struct<pos:int,kind:string>>", E.error_string(E.shift_by_indels(F.col("e"))))
    assert [g[0] for g in got] == ["10I,21A", "10D,19A", "10D,9G,10D"]


def test_restore_substitutions(spark):
    rows = [("ACGT", [(2, "T"), (9, "A"), (3, "I")]), ("ACGT", [])]
    got = values(spark, rows, "s string, e array<struct<pos:int,kind:string>>", E.restore_substitutions(F.col("s"), F.col("e")))
    assert [g[0] for g in got] == ["ATGT", "ACGT"]


def test_counts_of_missing_strings_are_zero(spark):
    got = values(
        spark, [(None, None, None), ("10A5^AC3T2", "38I,73D", "5S10M2I3=1X4D")], "md string, i string, c string",
        E.count_substitutions(F.col("md")), E.count_indels(F.col("i")), E.read_length_from_cigar(F.col("c")),
    )
    assert got == [(0, 0, 0), (2, 2, 21)]


def walk_segments(labels, frame):
    """Sequential rule for called segments."""
    out, start, kind = [], None, None
    for i, x in enumerate(labels):
        at = 3 * i + frame + 1
        if x in (1, 2, 4) and start is None:
            start, kind = at, {2: "start_codon", 4: "indel_start"}.get(x, "internal_region")
        elif x in (0, 3, 5) and start is not None:
            end = at + 2 if x in (3, 5) else at - 1
            out.append((start, end, frame, kind, {3: "stop_codon", 5: "indel_stop"}.get(x, "internal_region")))
            start = None
    if start is not None:
        out.append((start, 3 * len(labels) + frame, frame, kind, "internal_region"))
    return out


def walk_intervals(labels, frame):
    """Sequential rule for truth intervals."""
    out, start = [], None
    for i, x in enumerate(labels):
        if x in (1, 2):
            start = 3 * i + frame + 1 if start is None else start
        elif x == 3:
            end = 3 * (i + 1) + frame
            out.append((end - 2 if start is None else start, end, frame))
            start = None
        elif start is not None:
            out.append((start, 3 * i + frame, frame))
            start = None
    if start is not None:
        out.append((start, 3 * len(labels) + frame, frame))
    return out


def test_runs_match_the_sequential_rules(spark):
    rng = random.Random(5)
    arrays = [[], [3], [1], [0, 2, 1, 3, 0]] + [[rng.choice([0, 0, 1, 1, 1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 40))] for _ in range(120)]
    simple = [[x if x < 4 else 1 for x in a] for a in arrays]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(arrays, simple))]
    df = spark.createDataFrame(rows, "i int, a array<tinyint>, b array<tinyint>")
    for frame in range(3):
        got = df.select("i", L.segments(F.col("a"), frame).alias("s"), L.truth_intervals(F.col("b"), frame).alias("t")).collect()
        for r in got:
            assert [tuple(x) for x in r.s] == walk_segments(arrays[r.i], frame)
            assert [tuple(x) for x in r.t] == walk_intervals(simple[r.i], frame)


def test_indel_borders_and_codon_labels(spark):
    rows = [([0, 1, 1, 0],), ([0, 1, 0],), ([1, 1, 0, 2, 2, 2],), ([1, 1, 1, 1],), ([0, 1, 1, 1, 3],)]
    got = values(spark, rows, "a array<tinyint>", L.mark_indel_borders(F.col("a")), L.codon_labels(F.col("a")))
    assert [g[0] for g in got] == [[0, 4, 5, 0], [0, 4, 0], [1, 5, 0, 2, 2, 2], [1, 1, 1, 1], [0, 4, 1, 1, 3]]
    assert [g[1] for g in got] == [[0, 0], [0], [0, 2], [1, 1], [0, 1]]


def walk_labels(start, length, cds, ops, frame):
    """Base-by-base rule for labels through insertions and deletions."""
    wanted = (length - frame) // 3 * 3
    at, shift, labels, first = start + frame, 0, [], True
    for op, n in ops:
        n, first = (n - frame if first else n), False
        if n < 1:
            continue
        if op == "D":
            shift -= n
        elif op == "I":
            labels += [0] * n
            shift += n
        else:
            for _ in range(n):
                base, label = at + len(labels), 0
                for s, e in cds:
                    s, e = s + shift, e + shift
                    if s <= base <= e and (s - at) % 3 == 0:
                        label = 2 if base < s + 3 else 3 if base > e - 3 else label or 1
                labels.append(label)
    return labels[:wanted] if len(labels) >= wanted else None


def test_labels_through_indels(spark):
    rng = random.Random(3)
    cases = []
    for i in range(60):
        ops, left = [], 60
        while left > 0:
            op = rng.choice("MMMID") if ops else rng.choice("MMI")
            n = rng.randint(1, 25) if op == "M" else rng.randint(1, 2)
            n = min(n, left) if op != "D" else n
            ops.append((op, n))
            left -= n if op != "D" else 0
        cds = sorted((s, s + 3 * rng.randint(1, 15) - 1) for s in rng.sample(range(70, 170), rng.randint(0, 4)))
        cases.append((i, 100, cds, "".join(f"{n}{op}" for op, n in ops), ops))
    schema = "i int, start long, cds array<struct<start:long,end:long>>, cigar string"
    df = spark.createDataFrame([c[:4] for c in cases], schema).withColumn("ops", E.parse_cigar(F.col("cigar")))
    for frame in range(3):
        nt = L.nt_labels_with_indels(F.col("start"), F.lit(60), F.col("cds"), F.col("ops"), frame)
        plain = L.frame_labels(F.col("start"), F.lit(60), F.col("cds"), frame)
        for r in df.select("i", nt.alias("nt"), plain.alias("plain")).collect():
            _, start, cds, _, ops = cases[r.i]
            assert r.nt == walk_labels(start, 60, cds, ops, frame)
            assert r.plain == walk_labels(start, 60, cds, [("M", 60)], frame)[::3]


def test_gc_bins_and_iou(spark):
    got = values(spark, [(39.9,), (40.0,), (100.0,)], "g double", C.gc_bin(F.col("g")))
    assert [g[0] for g in got] == ["0-40", "40-50", None]
    frag = "array<struct<start:int,end:int,rf:int>>"
    rows = [
        ([(1, 100, 0)], [(1, 100, 0)]), ([(1, 100, 0)], [(50, 150, 0)]), ([(1, 100, 0)], [(1, 100, 1)]),
        ([(1, 100, 0)], [(1, 100, 0), (102, 200, 1)]), ([(1, 100, 0), (102, 200, 1)], [(1, 100, 0)]),
        ([(1, 100, 0), (102, 200, 1)], [(1, 100, 0), (102, 200, 1)]),
    ]
    got = values(spark, rows, f"p {frag}, t {frag}", F.round(C.fragment_iou(F.col("p"), F.col("t")), 6))
    assert [g[0] for g in got] == [1.0, round(50 / 149, 6), 0.0, 1.0, round(99 / 197, 6), 1.0]


def test_merge_fragments_and_flip(spark):
    rows = [(["AAA", "CCC"], [None, "insertion"]), (["AAA", "CCC"], [None, "deletion"])]
    got = values(spark, rows, "f array<string>, g array<string>", C.merge_fragments(F.col("f"), F.col("g")))
    assert [g[0] for g in got] == ["AAACCC", "AAANNNCCC"]
    assert values(spark, [(300, 2, 298)], "n int, s int, e int", *S.flip(F.col("n"), F.col("s"), F.col("e"))) == [(3, 299)]


def test_masking_repeats_itself(spark):
    rows = [(f"r{i}", "ACGT" * 500) for i in range(20)]
    masked = S.mask_bases(F.col("s"), F.col("n"), 42, 50_000)
    first, second = (values(spark, rows, "n string, s string", masked) for _ in range(2))
    assert first == second
    share = sum(g[0].count("N") for g in first) / (20 * 2000)
    assert 0.04 < share < 0.06
