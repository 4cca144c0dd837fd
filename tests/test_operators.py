"""Operators against brute force on small data."""

import random
import time
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readframe.functions.labels import LEGAL_SIX
from readframe.operators import containment, datasets, decode, evaluate, frameshift, intervals, scan, slices, stats, taxonomy

PLACE = ["assembly_id", "strand"]


def intervals_df(spark, n, seed, prefix="", span=20_000, longest=900):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randint(1, span)
        rows.append((rng.choice("ab"), rng.choice("+-"), s, s + rng.randint(0, longest)))
    return spark.createDataFrame(rows, f"assembly_id string, strand string, {prefix}start long, {prefix}end long"), rows


def test_overlap_pairs_with_a_hot_bin(spark):
    reads, rows = intervals_df(spark, 300, 1, longest=400)
    hot = [("a", "+", 500, 800)] * 400
    rows = [(f"r{i}", *r) for i, r in enumerate(rows + hot)]
    reads = spark.createDataFrame(rows, "read_id string, assembly_id string, strand string, start long, end long")
    cds, genes = intervals_df(spark, 200, 2, "cds_", longest=3000)
    pairs = intervals.overlap_pairs(reads, cds, width=256, hot_rows=50)
    want = [(r[0], g[2], g[3]) for r in rows for g in genes if r[1:3] == g[:2] and r[3] <= g[3] and g[2] <= r[4]]
    assert sorted((p.read_id, p.cds_start, p.cds_end) for p in pairs.collect()) == sorted(want)


def test_without_uncertain(spark):
    reads, rows = intervals_df(spark, 300, 3)
    cds, genes = intervals_df(spark, 30, 4, "cds_")
    left = intervals.without_uncertain(reads, cds, 300, width=128)
    want = [r for r in rows if not any(r[:2] == g[:2] and g[2] - 300 <= r[2] <= g[3] for g in genes)]
    assert sorted(map(tuple, left.collect())) == sorted(want)


def test_merge_regions(spark):
    cds, genes = intervals_df(spark, 500, 5, "cds_", longest=60)
    want = []
    for a, s, lo, hi in sorted(genes):
        if want and want[-1][:2] == [a, s] and lo <= want[-1][3]:
            want[-1][3] = max(want[-1][3], hi)
            want[-1][4] += 1
        else:
            want.append([a, s, lo, hi, 1])
    got = intervals.merge_regions(cds, PLACE, width=300).select(*PLACE, "region_start", "region_end", "n_cds").collect()
    assert sorted(map(list, got)) == want


def test_check_annotations_keeps_one_per_start_and_end(spark):
    rows = [("a", "+", 10, 39, True), ("a", "+", 10, 69, True), ("a", "+", 40, 69, True), ("a", "+", 100, 130, True), ("a", "+", 10, 69, True), ("a", "+", 5, 9, False)]
    df = spark.createDataFrame(rows, "assembly_id string, strand string, cds_start long, cds_end long, certain boolean")
    got = sorted(tuple(r) for r in intervals.check_annotations(df).collect())
    assert got == [("a", "+", 5, 9, False), ("a", "+", 10, 69, True), ("a", "+", 100, 130, False)]


def test_indels_must_match_the_frame_step(spark):
    frag, err = "array<struct<start:int,end:int,rf:int,cds_group:int>>", "array<struct<pos:int,kind:string>>"
    chain = [(1, 30, 0, 0), (32, 61, 1, 0), (70, 90, 2, 1)]
    rows = [(chain, []), (chain, [(31, "I")]), (chain, [(31, "D")]), (chain, [(65, "D")])]
    df = spark.createDataFrame(rows, f"f {frag}, e {err}")
    got = [r[0] for r in df.select(intervals.indels_match_frames(F.col("f"), F.col("e"))).collect()]
    assert got == [True, True, False, True]


def test_chains_of_a_long_read_take_linear_time():
    """chains that ended long ago are not looked at again."""
    rows = [{"start": 12 * i + 1, "end": 12 * i + 3, "rf": 0} for i in range(30_000)]
    began = time.perf_counter()
    found = frameshift._group_fragments(rows, 400_000, 6)
    assert time.perf_counter() - began < 10
    assert [f["cds_group"] for f in found] == list(range(30_000))


def test_segments_are_folded_in_slices():
    """Python objects are made for few segments at a time, whatever the size of an Arrow batch."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string())]))
    rows = [[{"start": i, "kind": "a"}, {"start": None, "kind": None}] * n for i, n in enumerate((3, 0, 40, 1, 2))] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["x"])
    parts = list(slices.in_slices(iter([batch.slice(1)]), "x", items=10))
    assert [len(p) for p in parts] == [1, 1, 3]
    assert [r for p in parts for r in slices.records(p.column("x"))] == rows[1:]
    assert slices.from_records(rows, kind).to_pylist() == rows


def test_contained_fragments(spark):
    rng = random.Random(7)
    proteins = [(rng.choice("gh"), "".join(rng.choices("ACDW", k=rng.randint(1, 60)))) for _ in range(40)]
    fragments = []
    for _ in range(300):
        g, p = rng.choice(proteins)
        at = rng.randrange(len(p))
        fragments.append((rng.choice("gh"), p[at : at + rng.randint(1, 30)].replace("W", rng.choice("WX"))))
        fragments.append((g, "".join(rng.choices("ACDWX", k=rng.randint(1, 12)))))
    got = containment.contained_fragments(
        spark.createDataFrame(fragments, "accession string, fragment string"), spark.createDataFrame(proteins, "accession string, protein string"), seed=5
    )
    want = {(a, f) for a, f in fragments if any(a == g and f.replace("X", "W") in p for g, p in proteins)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    reads = spark.createDataFrame([("r1", "g", []), ("r2", "g", ["QQQ"])], "read_id string, accession string, fragments array<string>")
    kept = containment.reads_with_known_fragments(reads, spark.createDataFrame(proteins, "accession string, protein string"), ["accession", "read_id"])
    assert [r.read_id for r in kept.collect()] == ["r1"]


def test_fragments_of_one_seed_do_not_meet_in_pairs(spark):
    """as many fragments as texts share a seed; in pairs they would be a hundred million rows."""
    n = 20_000
    proteins = spark.range(n, numPartitions=1).selectExpr("'g' as accession", "concat('AAAAACCCCC', reverse(lpad(id, 6, '0')), 'D') as protein")
    asked = spark.range(n, numPartitions=1).selectExpr("'g' as accession", "concat('AAAACCCCC', substr(reverse(lpad(id, 6, '0')), 1, 6), if(id % 2 = 0, 'D', 'E')) as fragment")
    found = containment.contained_fragments(asked, proteins)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "startswith" in plan.lower() and "StartsWith(_window" not in plan and plan.count("LeftSemi") <= 1
    assert found.count() == n // 2
    alike = spark.createDataFrame([("g", "AAAAXCCCC"), ("g", "AAAAWCCCC"), (None, "AAAAACCCC")], "accession string, fragment string")
    got = containment.contained_fragments(alike, spark.createDataFrame([("g", "DAAAAWCCCC"), (None, "AAAAACCCC")], "accession string, protein string"))
    assert sorted(r.fragment for r in got.collect()) == ["AAAAWCCCC", "AAAAXCCCC"]


def test_short_fragments_share_the_windows_of_a_place(spark):
    """F8: a place goes on the way once for its short fragments, not once for each length, and once for its seed, as numbers."""
    proteins = spark.createDataFrame([("g", "ACDEFGHIKLMN"), ("h", "AC"), ("h", "WWDEF"), (None, "QRSTVW"), ("g", None)], "accession string, protein string")
    texts = ["A", "N", "AC", "MN", "ACD", "LMN", "DEFX", "HIKLMN", "ACDEFGH", "FGHIKLM", "GHIKLMA", "XX", "XXDE", "ACDEFGHI", "EFGHIKLMN", "FGHIKLMNA", "QRS", "QRSTVW", "Q"]
    asked = spark.createDataFrame([(g, x) for g in ("g", "h", None) for x in texts], "accession string, fragment string")
    found = containment.contained_fragments(asked, proteins)
    held = {"g": ["ACDEFGHIKLMN"], "h": ["AC", "WWDEF"], None: []}
    want = sorted((g, x) for g, own in held.items() for x in texts if any(x.replace("X", "W") in p for p in own))
    assert sorted(map(tuple, found.collect())) == want and len(want) == 15
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "{7}" not in plan and "{3,7}" in plan and "_q#" not in plan


def seg(start, end, frame, a="internal_region", b="internal_region"):
    return {"start": start, "end": end, "frame": frame, "start_type": a, "end_type": b}


def test_chain_segments(spark):
    chained, regions = frameshift._chain_read(
        [seg(1, 30, 0, "start_codon", "indel_stop"), seg(32, 58, 1, "indel_start", "indel_stop"), seg(57, 89, 2, "indel_start", "stop_codon"), seg(200, 250, 1)], 30
    )
    assert [(s["start"], s["end"], s["group_id"], s["fragment"], s["indel_type"], s["number"]) for s in chained] == [
        (1, 30, 1, 0, "insertion", None), (32, 55, 1, 1, "insertion", None), (60, 89, 1, 2, "insertion", None), (200, 250, None, None, None, 1),
    ]
    assert [(r["start"], r["end"], r["kind"]) for r in regions] == [(31, 31, "insertion"), (56, 59, "overlap")]
    # The first link may pass over a segment, a later one may not.
    skipping = [seg(1, 30, 0, b="indel_stop"), seg(32, 37, 1), seg(33, 50, 2, "indel_start", "indel_stop"), seg(52, 60, 0), seg(53, 70, 1, "indel_start")]
    chained, _ = frameshift._chain_read(skipping, 30)
    assert [s["group_id"] for s in chained] == [1, None, 1, None, None]
    assert [s["number"] for s in chained] == [None, None, None, None, None]


def test_chain_segments_job(spark):
    schema = "name string, segments array<struct<start:int,end:int,frame:int,start_type:string,end_type:string>>"
    df = spark.createDataFrame([("a", []), ("b", [(1, 60, 0, "internal_region", "internal_region")])], schema)
    rows = {r.name: r for r in frameshift.chain_segments(df, 30).collect()}
    assert rows["a"].segments == [] and rows["b"].segments[0].number == 1 and rows["b"].regions == []


def test_truth_chains_prefer_the_nearest_fragment():
    rows = [{"start": s, "end": e, "rf": r} for s, e, r in [(1, 30, 0), (33, 50, 2), (35, 61, 1), (200, 298, 1)]]
    assert [f["cds_group"] for f in frameshift._group_fragments(rows, 300, 6)] == [0, 0, 1, 2]
    # A border base past the labelled part stops a chain.
    ends = [{"start": 4, "end": 30, "rf": 0}, {"start": 32, "end": 34, "rf": 1}]
    assert [f["cds_group"] for f in frameshift._group_fragments(ends, 33, 6)] == [0, 1]


def split_walk(start, end, rf, insertions, deletions):
    out, at = [], start
    for b in sorted(set(insertions + deletions)) + [end + 1]:
        first, last = max(at, start), min(b - 1, end)
        if at <= min(b - 1, end) and b - 1 >= start and first <= last:
            while (first - rf) % 3 != 1:
                first += 1
            while (last - first + 1) % 3:
                last -= 1
            if (abs(last - first) + 1) % 3 == 0:
                out.append((first, last, rf))
        if b in deletions:
            rf, at = (rf - 1) % 3, b
        elif b in insertions:
            rf, at = (rf + 1) % 3, b + 1
        else:
            at = b
    return out


def test_split_at_indels(spark):
    rng = random.Random(11)
    rows = []
    for i in range(80):
        s = rng.randint(1, 20)
        pos = rng.sample(range(s, s + 120), 4)
        rows.append((i, s, s + rng.randint(30, 120), (s - 1) % 3, pos[: rng.randint(0, 3)], pos[2 : rng.randint(2, 4)]))
    df = spark.createDataFrame(rows, "i int, s int, e int, rf int, ins array<int>, dels array<int>")
    got = df.select("i", frameshift.split_at_indels(*[F.col(c) for c in ("s", "e", "rf", "ins", "dels")]).alias("p")).collect()
    for r in got:
        assert [tuple(p) for p in r.p] == split_walk(*rows[r.i][1:])


def test_best_paths_by_enumeration(spark):
    rng = np.random.default_rng(2)
    classes = [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    steps = decode.transition_scores(classes, -0.5)
    assert steps[0, 1] == -10 and steps[1, 1] == 0 and steps[0, 2] == -0.5 and 1 in LEGAL_SIX[1]
    start, end = rng.normal(size=3), rng.normal(size=3)
    reads = [rng.normal(size=(n, 3)) * 3 for n in (6, 6, 4, 1)]
    for scores, path in zip(reads, decode._best_paths(reads, steps, start, end)):
        total = lambda p: start[p[0]] + end[p[-1]] + sum(scores[i, c] for i, c in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(path) == max(product(range(3), repeat=len(scores)), key=total)


def cds_rows(spark, rows, model=False):
    head = "model string, " if model else ""
    return spark.createDataFrame(rows, head + "testset string, accession string, read_name string, cds_group string, start int, end int, rf int")


def test_exact_and_iou_matches(spark):
    truth = cds_rows(spark, [("t", "g", "r", None, 1, 90, 0), ("t", "g", "r", None, 1, 90, 0), ("t", "g", "r", None, 31, 90, 0), ("t", "g", "q", "x", 1, 30, 0), ("t", "g", "q", "x", 32, 61, 1)])
    pred = cds_rows(spark, [("m", "t", "g", "r", None, 1, 90, 0), ("m", "t", "g", "r", None, 1, 81, 0), ("m", "t", "g", "r", None, 2, 91, 1), ("m", "t", "g", "q", "y", 1, 30, 0), ("m", "t", "g", "q", "y", 32, 61, 1)], True)
    keys = ["testset", "accession", "read_name"]
    whole = evaluate.for_models(evaluate.whole_cds(truth, keys), ["m"]), evaluate.whole_cds(pred, ["model", *keys])
    exact = {r.read_name: (r.tp, r.fp, r.fn) for r in evaluate.exact_match_counts(*whole).collect()}
    assert exact == {"r": (1, 2, 2), "q": (1, 0, 0)}
    near = {r.read_name: (r.tp, r.fp, r.fn) for r in evaluate.iou_match_counts(*whole, 0.8).collect()}
    assert near == {"r": (2, 1, 1), "q": (1, 0, 0)}


def test_iou_greedy_against_unit_copies():
    rng = random.Random(4)

    def items(n):
        out = []
        for _ in range(n):
            s = rng.randint(1, 60)
            out.append(([(s, s + rng.choice([30, 45, 60]), 0)], rng.randint(1, 3)))
        return sorted(out)

    def unit(preds, truths, limit):
        spread = lambda xs: [spans[0] for spans, n in xs for _ in range(n)]
        truths, used, hits = spread(truths), set(), 0
        for p in spread(preds):
            best, at = 0.0, None
            for i, t in enumerate(truths):
                shared = max(0, min(p[1], t[1]) - max(p[0], t[0]))
                iou = shared / (p[1] - p[0] + t[1] - t[0] - shared)
                if i not in used and iou >= limit and iou > best:
                    best, at = iou, i
            if at is not None:
                used.add(at)
                hits += 1
        return hits

    for _ in range(200):
        preds, truths = items(rng.randint(1, 5)), items(rng.randint(1, 5))
        assert evaluate._greedy_matches(preds, truths, 0.4) == unit(preds, truths, 0.4)


def test_closest_pairs_against_the_pair_table():
    rng = random.Random(9)
    for _ in range(300):
        truths, preds = (sorted(rng.choices(range(1, 40), k=rng.randint(0, 7))) for _ in range(2))
        pairs = sorted((abs(t - p), i, j) for i, t in enumerate(truths) for j, p in enumerate(preds))
        used_t, used_p, total = set(), set(), 0
        for d, i, j in pairs:
            if i not in used_t and j not in used_p:
                used_t.add(i), used_p.add(j)
                total += d
        items = [(x, truths.count(x), preds.count(x)) for x in sorted({*truths, *preds})]
        assert evaluate._closest_pairs(items) == (len(used_t), total)


def test_codon_confusion_counts_add_up(spark):
    keys = ["testset", "accession", "read_name"]
    truth = evaluate.whole_cds(cds_rows(spark, [("t", "g", "r", None, 1, 300, 0), ("t", "g", "r", None, 1, 300, 0), ("t", "g", "r", None, 3, 32, 2)]), keys)
    pred = evaluate.whole_cds(cds_rows(spark, [("m", "t", "g", "r", None, 31, 90, 0)], True), ["model", *keys])
    reads = spark.createDataFrame([("t", "g", "r", 300), ("t", "g", "empty", 300)], "testset string, accession string, read_name string, length int")
    got = {r.model: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.codon_confusion(truth, pred, reads, ["m", "none"]).collect()}
    assert got["m"] == (20, 0, 89, 594 - 109) and got["none"] == (0, 0, 109, 594 - 109)


def test_start_stop_at_the_read_border(spark):
    keys = ["testset", "accession", "read_name"]
    truth = evaluate.whole_cds(cds_rows(spark, [("t", "g", "r", None, 1, 300, 0), ("t", "g", "q", None, 4, 90, 0)]), keys)
    codons = evaluate.boundary_codons(truth, F.lit(300), keys)
    assert sorted((r.read_name, r.kind, r.pos) for r in codons.collect()) == [("q", "start", 4), ("q", "stop", 90)]


def test_permutation_test_and_holm(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        hit = rng.random()
        for model, rate in (("a", 0.9), ("b", 0.9), ("c", 0.3)):
            good = hit < rate if model != "b" else rng.random() < 0.9
            rows.append((model, "t", f"g{i % 6}", f"r{i}", int(good), 0, int(not good)))
    counts = spark.createDataFrame(rows, "model string, testset string, accession string, read_name string, tp long, fp long, fn long")
    tests = stats.holm(stats.permutation_test(counts, ["a", "b", "c"], 500), ["testset"], ["model_a", "model_b"])
    got = {(r.model_a, r.model_b): r for r in tests.collect()}
    assert got["a", "c"].p_value == 1 / 500 and got["a", "b"].p_value > 0.05
    assert got["a", "c"].p_holm == 3 / 500
    again = {(r.model_a, r.model_b): r.p_value for r in stats.permutation_test(counts, ["a", "b", "c"], 500).collect()}
    assert again == {k: r.p_value for k, r in got.items()}
    few = spark.createDataFrame([("t", "a", "b", 0.01), ("t", "a", "c", 0.04), ("t", "b", "c", 0.03)], "testset string, model_a string, model_b string, p_value double")
    assert [round(r.p_holm, 6) for r in stats.holm(few, ["testset"], ["model_a", "model_b"]).orderBy("model_a", "model_b").collect()] == [0.03, 0.06, 0.06]


def test_smallest_per_stratum_is_exact(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("s"), F.lit(7).alias("q"))
    drawn = scan.smallest_per_stratum(rows, ["s"], "q", datasets.draw63(F.lit(1), F.col("id")), "id", coarse_bits=4)
    kept = drawn.collect()
    assert sorted(r.s for r in kept) == [0] * 7 + [1] * 7
    order = rows.withColumn("d", datasets.draw63(F.lit(1), F.col("id"))).orderBy("s", "d").collect()
    want = {r.id for s in (0, 1) for r in [x for x in order if x.s == s][:7]}
    assert {r.id for r in kept} == want


def test_number_rows_and_weighted_sample(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 300, "x").otherwise("y").alias("c"))
    numbered = scan.number_rows(rows, ["c"], datasets.draw63(F.col("id")), "id", "n", coarse_bits=3).collect()
    assert sorted(r.n for r in numbered if r.c == "x") == list(range(300))
    sample = datasets.weighted_with_replacement(rows, "c", {"x": 3.0, "y": 1.0}, 2000, "id").collect()
    share = sum(r.c == "x" for r in sample) / 2000
    assert len(sample) == 2000 and abs(share - 900 / 1600) < 0.05


def genomes(spark, n=400):
    rows = [(f"g{i}", f"f{(i * i) % 23}", "Archaea" if (i * i) % 23 < 6 else "Bacteria", 20 + (i * 37 % 500) / 10) for i in range(n)]
    return spark.createDataFrame(rows, "accession string, family string, domain string, gc_content double")


def test_family_split_is_disjoint(spark):
    seeds = spark.createDataFrame([("g1",), ("g5",)], "accession string")
    split = datasets.split_by_family(genomes(spark), seeds).collect()
    parts = {}
    for r in split:
        parts.setdefault(r.family, set()).add(r.partition)
    assert len(split) == 400 and all(len(p) == 1 for p in parts.values())
    assert parts["f1"] == {"test"} and {p for s in parts.values() for p in s} == {"train", "val", "test"}


def test_proportional_subsample(spark):
    pool = genomes(spark)
    ends = {r.accession for r in datasets.gc_extremes(pool).collect()}
    for target in (3, 50, 200, 1000):
        sample = datasets.proportional_subsample(pool, target).collect()
        assert len({r.accession for r in sample}) == len(sample) == min(target, 400)
        assert ends <= {r.accession for r in sample}
    quotas = datasets.family_quotas(pool, 50).collect()
    assert sum(r.quota for r in quotas) == 50


def test_lineages_and_tree(spark):
    nodes = [("1", "1", "no rank"), ("2", "1", "domain"), ("10", "2", "family"), ("100", "10", "genus"), ("1000", "100", "species"), ("7", "1", "domain"), ("70", "7", "species")]
    names = [(n, f"name {n}") for n, _, _ in nodes]
    taxa = spark.createDataFrame([("A", "1000"), ("B", "1000"), ("C", "70"), ("D", "100")], "accession string, tax_id string")
    found = taxonomy.lineages(
        taxa, spark.createDataFrame(nodes, "tax_id string, parent_id string, rank string"), spark.createDataFrame(names, "tax_id string, name string")
    )
    rows = {r.accession: r for r in taxonomy.rank_columns(found).collect()}
    assert set(rows) == {"A", "B", "D"} and rows["A"].species == "name 1000" and rows["D"].species is None and rows["D"].domain == "name 2"
    leaves = spark.createDataFrame([("A", "d1", "f (1)"), ("B", "d1", None), ("C", "d2", "f2")], "accession string, domain string, family string")
    tree = "".join(r.token for r in taxonomy.newick_tokens(leaves, ["domain", "family"]).orderBy("sort_key").collect())
    assert tree == "(((B)Unknown_family,(A)f_[1])d1,((C)f2)d2)root;"
