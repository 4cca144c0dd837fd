"""Predicted CDSs against the truth.

CDS tables have testset, accession, read_name, cds_group, start, end, rf, and predictions also model.  Rows with the
same non-NULL cds_group of a read are fragments of one CDS that an indel broke.  Truth and predictions are stacked and
aggregated on the match key rather than joined, so each comparison is one shuffle with partial sums before it, and
copies of a row cost one row after the map side.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions.metrics import precision, recall, with_scores
from readframe.session import checkpointed, task_number

GENOME = ["model", "testset", "accession"]
READ = [*GENOME, "read_name"]
BROKEN = -1  # frame code of a broken CDS in match keys


def for_models(truth: DataFrame, models: list[str]) -> DataFrame:
    """The truth once per model, so that models without any prediction still get their misses."""
    return truth.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def whole_cds(cds: DataFrame, keys: list[str]) -> DataFrame:
    """One row per CDS: start, end, rf (NULL if broken), fragments (start, end, rf) in order.

    Rows are dealt out by read once.  Whatever later groups or stacks CDSs of a read finds them in place, so that an
    evaluation shuffles each side once.  Unbroken CDSs, which most are, go on as they are; only fragments are grouped.
    """
    spans = "array<struct<start:int,end:int,rf:int>>"
    fragment = F.struct(*[F.col(c).cast("int").alias(c) for c in ("start", "end", "rf")])
    dealt = cds.repartition(*[k for k in keys if k != "model"]).select(*keys, "cds_group", fragment.alias("_own"))
    # An exploded flag is told apart behind the shuffle, so that both kinds read the same one.
    kinds = dealt.withColumn("_is_single", F.explode(F.array(F.col("cds_group").isNull())))
    own, parts = F.col("_own"), F.col("_parts")
    single = kinds.filter("_is_single").select(
        *keys, own["start"].alias("start"), own["end"].alias("end"), own["rf"].alias("rf"), F.array(own).cast(spans).alias("fragments")
    )
    # The hash in front makes a cheap first key where the grouping has to sort.
    grouped = (
        kinds.filter(~F.col("_is_single"))
        .groupBy(F.xxhash64(*keys, "cds_group").alias("_hash"), *keys, "cds_group")
        .agg(F.array_sort(F.collect_list("_own")).cast(spans).alias("_parts"))
    )
    first = F.get(parts, F.lit(0))
    chained = grouped.select(
        *keys, first["start"].alias("start"), F.get(parts, F.size(parts) - 1)["end"].alias("end"),
        F.when(F.size(parts) == 1, first["rf"]).alias("rf"), parts.alias("fragments"),
    )
    return single.unionByName(chained)


def _stack(truth: DataFrame, pred: DataFrame, columns: list) -> DataFrame:
    """Both sides with 0/1 flags in_truth and in_pred."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return truth.select(*columns, one.alias("in_truth"), zero.alias("in_pred")).unionByName(
        pred.select(*columns, zero.alias("in_truth"), one.alias("in_pred"))
    )


def _totals(per_key: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn per ``keys`` from n_truth, n_pred, tp."""
    return per_key.groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_truth") - F.col("tp")).alias("fn")
    )


def exact_match_counts(truth: DataFrame, pred: DataFrame, keys: list[str] = READ) -> DataFrame:
    """tp, fp, fn per ``keys``; a pair matches on read, start, end and frame, each row used once.

    Input is whole CDSs; both tables have the READ columns.  With copies of a key on both sides, the smaller number of
    copies is matched.  A broken CDS matches only a broken one.
    """
    code = F.coalesce("rf", F.lit(BROKEN)).alias("rf_code")
    stacked = _stack(truth, pred, [*READ, "start", "end", code])
    per_key = (
        stacked.groupBy(*READ, "start", "end", "rf_code")
        .agg(F.sum("in_truth").alias("n_truth"), F.sum("in_pred").alias("n_pred"))
        .withColumn("tp", F.least("n_truth", "n_pred"))
    )
    return _totals(per_key, keys)


def _side_by_side(truth: DataFrame, pred: DataFrame, models: list[str], columns: list) -> DataFrame:
    """Both sides with 0/1 flags: ``_t`` for the truth, which is there once, and ``_p0`` .. for the models' predictions."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    none = [zero.alias(f"_p{i}") for i in range(len(models))]
    of_model = [F.when(F.col("model") == m, one).otherwise(zero).alias(f"_p{i}") for i, m in enumerate(models)]
    return truth.select(*columns, one.alias("_t"), *none).unionByName(pred.select(*columns, zero.alias("_t"), *of_model))


def _model_totals(per_key: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """tp, fp, fn per ``keys``, model among them, from the numbers of truths and of each model's predictions.

    A model has a row wherever there is a truth or a prediction of its own.
    """
    sides = [f"_p{i}" for i in range(len(models))]
    hits = [F.sum(F.least("_t", side)).alias(f"{side}_tp") for side in sides]
    sums = per_key.groupBy(*[k for k in keys if k != "model"]).agg(*[F.sum(c).alias(c) for c in ("_t", *sides)], *hits)

    def counts(m: str, side: str) -> Column:
        tp = F.col(f"{side}_tp")
        row = F.struct(F.lit(m).alias("model"), tp.alias("tp"), (F.col(side) - tp).alias("fp"), (F.col("_t") - tp).alias("fn"))
        return F.when((F.col("_t") > 0) | (F.col(side) > 0), row)

    rows = F.array_compact(F.array(*[counts(m, side) for m, side in zip(models, sides)]))
    return sums.select(*[k for k in keys if k != "model"], F.inline(rows)).select(*keys, "tp", "fp", "fn")


def exact_match_counts_by_model(truth: DataFrame, pred: DataFrame, models: list[str], keys: list[str] = READ) -> DataFrame:
    """What :func:`exact_match_counts` gives for the truth of each model, with the models' counts in one row of a place.

    ``truth`` has no model, so it is there once; ``models`` names all that ``pred`` has, and ``keys`` holds model.
    """
    place = ["testset", "accession", "read_name", "start", "end", "rf_code"]
    stacked = _side_by_side(truth, pred, models, [*place[:-1], F.coalesce("rf", F.lit(BROKEN)).alias("rf_code")])
    numbers = [F.sum(c).alias(c) for c in ("_t", *[f"_p{i}" for i in range(len(models))])]
    return _model_totals(stacked.groupBy(*place).agg(*numbers), models, keys)


Cds = tuple[list[tuple[int, int, int]], int]  # fragments (start, end, rf) and the number of copies


def _greedy_matches(preds: list[Cds], truths: list[Cds], threshold: float) -> int:
    """Each prediction, in order, takes the free truth it overlaps best; copies are taken together."""
    free = [copies for _, copies in truths]
    # Truth fragments per frame in start order: a prediction looks only at those that can overlap it.
    by_frame: dict[int, list[tuple[int, int, int]]] = {}
    for i, (fragments, _) in enumerate(truths):
        for a, b, rf in fragments:
            by_frame.setdefault(rf, []).append((a, b, i))
    longest = {rf: max(b - a for a, b, _ in rows) for rf, rows in by_frame.items()}
    for rows in by_frame.values():
        rows.sort()
    matched = 0
    for spans, left in preds:
        length = sum(e - s for s, e, _ in spans)
        shared: dict[int, int] = {}
        for s, e, rf in spans:
            rows = by_frame.get(rf, [])
            for a, b, i in rows[bisect_left(rows, (s - longest.get(rf, 0),)) : bisect_left(rows, (e,))]:
                if b > s and free[i]:
                    shared[i] = shared.get(i, 0) + min(e, b) - max(s, a)
        found = []
        for i, common in shared.items():
            # An unbroken prediction is held against the truth's fragments in its own frame only.
            held = sum(b - a for a, b, r in truths[i][0] if len(spans) > 1 or r == spans[0][2])
            if common / (length + held - common) >= threshold:
                found.append((-common / (length + held - common), i))
        for _, i in sorted(found):
            taken = min(left, free[i])
            free[i] -= taken
            left -= taken
            matched += taken
            if left == 0:
                break
    return matched


def _regroup(owners, starts, ends, frames, copies) -> list[Cds]:
    """Flat fragment arrays of a read to its CDS list."""
    out: list[Cds] = [([], n) for n in copies.tolist()]
    for owner, *span in zip(owners.tolist(), starts.tolist(), ends.tolist(), frames.tolist()):
        out[owner][0].append(tuple(span))
    return out


def iou_match_counts(truth: DataFrame, pred: DataFrame, threshold: float, keys: list[str] = READ) -> DataFrame:
    """tp, fp, fn per ``keys`` with one-to-one matches of IoU at least ``threshold``.

    Predictions choose in the order unbroken before broken, then by coordinates; equal IoU goes to the first truth in
    the same order.  Copies are counted before a read's CDSs are put side by side, so its lists are bounded by the
    distinct spans on one read.  Reads with at most one CDS on each side never leave the JVM.
    """
    order = (F.size("fragments") > 1).alias("is_broken")
    stacked = _stack(truth, pred, [*READ, order, "start", "end", "fragments"])
    distinct = stacked.groupBy(*READ, "is_broken", "start", "end", "fragments").agg(
        F.sum("in_truth").alias("n_truth"), F.sum("in_pred").alias("n_pred")
    )

    def side(n: str) -> Column:
        item = F.struct("is_broken", "start", "end", "fragments", F.col(n).alias("n"))
        return F.array_sort(F.collect_list(F.when(F.col(n) > 0, item)))

    # The hash in front makes a cheap first key where the grouping has to sort.
    per_read = distinct.groupBy(F.xxhash64(*READ).alias("_hash"), *READ).agg(
        side("n_truth").alias("truths"), side("n_pred").alias("preds"),
        F.sum("n_truth").alias("n_truth"), F.sum("n_pred").alias("n_pred"),
    )
    easy = (F.least(F.size("preds"), F.size("truths")) == 0) | (F.greatest(F.size("preds"), F.size("truths")) == 1)
    p, t = F.get("preds", F.lit(0)), F.get("truths", F.lit(0))
    iou = C.fragment_iou(p["fragments"], t["fragments"])
    single = F.when((iou >= threshold) & (iou > 0), F.least(p["n"], t["n"])).otherwise(F.lit(0))
    tp = F.when(F.least(F.size("preds"), F.size("truths")) == 0, F.lit(0)).when(easy, single)

    # Flat integer arrays cross to Python far faster than nested rows.
    def flat(side: str) -> list[Column]:
        owners = F.flatten(F.transform(side, lambda c, i: F.transform(c["fragments"], lambda f: i)))
        spans = F.flatten(F.transform(side, lambda c: c["fragments"]))
        fields = [F.transform(spans, lambda f: f["start"]), F.transform(spans, lambda f: f["end"]), F.transform(spans, lambda f: f["rf"])]
        columns = [owners, *fields, F.transform(side, lambda c: c["n"])]
        return [F.when(~easy, c).alias(f"{side}_{i}") for i, c in enumerate(columns)]

    def match(hard: pa.RecordBatch) -> list[list[int]]:
        sides = [zip(*[_lists(hard.column(f"{side}_{i}")) for i in range(5)]) for side in ("preds", "truths")]
        return [[_greedy_matches(_regroup(*p), _regroup(*t), threshold) for p, t in zip(*sides)]]

    rows = per_read.select(*READ, "n_truth", "n_pred", tp.cast("long").alias("tp"), *flat("preds"), *flat("truths"))
    return _totals(_with_hard_rows(rows, ["tp"], match), keys)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _with_hard_rows(rows: DataFrame, out: list[str], fold) -> DataFrame:
    """READ, n_truth, n_pred and the ``out`` columns, which ``fold`` (batch -> a list per column) gives where they are NULL.

    All reads go by in one pass, so that what leads to them is not made once for the easy and once for the hard ones;
    easy reads cross as they are, without lists.
    """
    names = [*READ, "n_truth", "n_pred"]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_hard = batch.column(out[0]).is_null()
            columns = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).copy() for c in out]
            hard = batch.filter(is_hard)
            if hard.num_rows:
                for column, values in zip(columns, fold(hard)):
                    column[is_hard.to_numpy(zero_copy_only=False)] = values
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(c, pa.int64()) for c in columns]], [*names, *out])

    schema = ", ".join(f"{k} string" for k in READ) + ", n_truth long, n_pred long, " + ", ".join(f"{c} long" for c in out)
    return rows.mapInArrow(folded, schema)


def codon_confusion(
    truth: DataFrame, pred: DataFrame, reads: DataFrame, models: list[str], expand_broken: bool = True
) -> DataFrame:
    """Codon-level tp, fp, fn, tn per model, testset and accession over all three frames.

    ``reads`` (testset, accession, read_name, length) is the universe; a read of length L has (L-3) div 3 codons per
    frame.  CDSs set bits in 64-codon words that are OR-ed per read and frame, so overlapping or copied CDSs count a
    codon once and a CDS costs one or two rows however long it is.  ``expand_broken=False`` leaves broken CDSs out.
    """

    def words(cds: DataFrame, keys: list[str]) -> DataFrame:
        kept = cds if expand_broken else cds.filter(F.size("fragments") == 1)
        spans = kept.select(*keys, F.inline("fragments"))
        first = F.greatest(F.floor((F.col("start") - 1 - F.col("rf")) / 3), F.lit(0)).cast("int")
        last = (F.floor((F.col("end") - F.col("rf")) / 3) - 1).cast("int")
        ranges = spans.select(*keys, "rf", first.alias("a"), last.alias("b")).filter("a <= b")
        split = ranges.withColumn("word", F.explode(F.expr("cast(sequence(a div 64, b div 64) as array<int>)")))
        low = F.greatest(F.col("a") - F.col("word") * 64, F.lit(0))
        high = F.least(F.col("b") - F.col("word") * 64, F.lit(63))
        # Bits low..high: all ones, moved left to start at low, without those above high.
        mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - (high - low))
        return split.select(*keys, "rf", "word", F.call_function("shiftleft", mask, low).alias("mask"))

    none = F.lit(0).cast("long")
    read = ["testset", "accession", "read_name"]
    # The models' words lie side by side, so that a place is one group and the truth is there once.
    sides = [f"_p{i}" for i in range(len(models))]
    of_model = [F.when(F.col("model") == m, F.col("mask")).otherwise(none).alias(side) for side, m in zip(sides, models)]
    stacked = (
        words(truth, read)
        .select(*read, "rf", "word", F.col("mask").alias("t"), *[none.alias(side) for side in sides])
        .unionByName(words(pred, READ).select(*read, "rf", "word", none.alias("t"), *of_model))
    )
    covered = stacked.groupBy(*read, "rf", "word").agg(*[F.bit_or(c).alias(c) for c in ("t", *sides)])
    # Codons past the counted part of a read do not count: cut the words at the read's codon number.
    codons = F.floor((F.col("length") - 3) / 3).cast("int")
    universe = reads.select(*read, codons.alias("codons"))
    room = F.col("codons") - F.col("word") * 64
    inside = (
        F.when(room >= 64, F.lit(-1).cast("long"))
        .when(room <= 0, none)
        .otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), room) - 1)
    )
    cut = covered.join(universe, read).select("testset", "accession", *[F.col(c).bitwiseAND(inside).alias(c) for c in ("t", *sides)])
    t = F.col("t")
    sums = {}
    for side in sides:
        p = F.col(side)
        sums[f"{side}_tp"] = F.sum(F.bit_count(t.bitwiseAND(p)))
        sums[f"{side}_fp"] = F.sum(F.bit_count(p.bitwiseAND(F.bitwise_not(t))))
        sums[f"{side}_fn"] = F.sum(F.bit_count(t.bitwiseAND(F.bitwise_not(p))))
    hits = cut.groupBy("testset", "accession").agg(*[total.alias(name) for name, total in sums.items()])
    sizes = universe.groupBy("testset", "accession").agg((F.sum("codons") * 3).alias("n_codons"))

    def counts(m: str, side: str) -> Column:
        return F.struct(F.lit(m).alias("model"), *[F.coalesce(f"{side}_{c}", F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])

    rows = F.inline(F.array(*[counts(m, side) for m, side in zip(models, sides)]))
    return (
        sizes.join(hits, ["testset", "accession"], "left")
        .select("testset", "accession", "n_codons", rows)
        .select(*GENOME, "tp", "fp", "fn", (F.col("n_codons") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
    )


def boundary_codons(cds: DataFrame, read_length: Column, keys: list[str] = READ) -> DataFrame:
    """Observed start and stop codons of whole CDSs as (kind, pos, rf_code); CDS ends at the read border are none."""
    code = F.coalesce("rf", F.lit(BROKEN))
    start = F.when(
        ~C.is_internal_start(F.col("start"), F.col("rf")), F.struct(F.lit("start").alias("kind"), F.col("start").alias("pos"))
    )
    stop = F.when(
        ~C.is_internal_stop(F.col("end"), read_length), F.struct(F.lit("stop").alias("kind"), F.col("end").alias("pos"))
    )
    found = cds.select(*keys, code.alias("rf_code"), F.explode(F.array_compact(F.array(start, stop))).alias("codon"))
    return found.select(*keys, "codon.kind", "codon.pos", "rf_code")


def boundary_counts(truth: DataFrame, pred: DataFrame, read_length: Column, keys: list[str] = GENOME) -> DataFrame:
    """tp, fp, fn of start and stop codons per ``keys`` and kind; a position counts once per read and frame."""
    place = [*READ, "kind", "pos", "rf_code"]
    stacked = _stack(boundary_codons(truth, read_length), boundary_codons(pred, read_length), place)
    per_place = (
        stacked.groupBy(*place)
        .agg(F.max("in_truth").alias("n_truth"), F.max("in_pred").alias("n_pred"))
        .withColumn("tp", F.least("n_truth", "n_pred"))
    )
    return _totals(per_place, [*keys, "kind"])


def boundary_counts_by_model(truth: DataFrame, pred: DataFrame, models: list[str], read_length: Column, keys: list[str] = GENOME) -> DataFrame:
    """What :func:`boundary_counts` gives for the truth of each model, with the models' flags in one row of a place.

    ``truth`` has no model, so it is there once; ``models`` names all that ``pred`` has, and ``keys`` holds model.
    """
    read = ["testset", "accession", "read_name"]
    place = [*read, "kind", "pos", "rf_code"]
    stacked = _side_by_side(boundary_codons(truth, read_length, read), boundary_codons(pred, read_length), models, place)
    flags = [F.max(c).alias(c) for c in ("_t", *[f"_p{i}" for i in range(len(models))])]
    return _model_totals(stacked.groupBy(*place).agg(*flags), models, [*keys, "kind"])


def _closest_pairs(items: list) -> tuple[int, int]:
    """(matches, summed distance) when ever the closest truth and prediction are paired and used up.

    ``items`` holds (pos, n_truth, n_pred) in position order.  The closest pair always lies side by side among the
    items that are left, so a heap over neighbours does without the table of all pairs.
    """
    points = []
    for pos, n_truth, n_pred in items:
        if n_truth:
            points.append([pos, n_truth, 0])
        if n_pred:
            points.append([pos, n_pred, 1])
    n = len(points)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and points[a][2] != points[b][2]:
            t, p = (a, b) if points[a][2] == 0 else (b, a)
            heapq.heappush(heap, (abs(points[a][0] - points[b][0]), points[t][0], points[p][0], a, b))

    def remove(i: int) -> None:
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] < n:
            before[after[i]] = before[i]
        offer(before[i], after[i])

    for i in range(n - 1):
        offer(i, i + 1)
    matches = distance = 0
    while heap:
        gap, _, _, a, b = heapq.heappop(heap)
        taken = min(points[a][1], points[b][1])
        if taken == 0 or after[a] != b:
            continue
        matches += taken
        distance += taken * gap
        for i in (a, b):
            points[i][1] -= taken
            if points[i][1] == 0:
                remove(i)
    return matches, distance


def indel_matches(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Per read: n_truth, n_pred, tp, distance (summed over matches) and the side(s) that hold indels.

    Both tables have the READ columns and pos.  Rows are dealt out by read once; copies of a position are counted
    before a read's list is made, which holds each position once.
    """
    places = (
        _stack(truth, pred, [*READ, F.col("pos").cast("int").alias("pos")])
        .repartition(task_number(truth), *READ)
        .groupBy(*READ, "pos")
        .agg(F.sum("in_truth").alias("n_truth"), F.sum("in_pred").alias("n_pred"))
    )
    # The hash in front makes a cheap first key where the grouping has to sort.
    per_read = places.groupBy(F.xxhash64(*READ).alias("_hash"), *READ).agg(
        F.array_sort(F.collect_list(F.struct("pos", "n_truth", "n_pred"))).alias("items"),
        F.sum("n_truth").alias("n_truth"),
        F.sum("n_pred").alias("n_pred"),
    )
    single = (F.col("n_truth") <= 1) & (F.col("n_pred") <= 1) | (F.least("n_truth", "n_pred") == 0)
    tp = F.when(single, F.least("n_truth", "n_pred")).alias("tp")
    reach = F.element_at("items", -1)["pos"] - F.get("items", F.lit(0))["pos"]
    gap = F.when(F.least("n_truth", "n_pred") == 0, 0).when(single, reach).cast("long").alias("distance")

    def match(hard: pa.RecordBatch) -> Iterator[tuple]:
        lists = zip(*[[a.tolist() for a in _lists(hard.column(c))] for c in ("pos", "truths", "preds")])
        return zip(*[_closest_pairs(list(zip(*read))) for read in lists])

    fields = {"pos": "pos", "truths": "n_truth", "preds": "n_pred"}
    flat = [F.when(~single, F.transform("items", lambda x: x[field])).alias(name) for name, field in fields.items()]
    rows = per_read.select(*READ, "n_truth", "n_pred", tp, gap, *flat)
    side = F.when(F.col("n_pred") == 0, "truth only").when(F.col("n_truth") == 0, "prediction only").otherwise("both")
    return _with_hard_rows(rows, ["tp", "distance"], match).withColumn("side", side)


def indel_metrics(matches: DataFrame, keys: list[str] = GENOME) -> DataFrame:
    """tp, fp, fn, MAE (NULL without matches), precision and sensitivity of indel calls."""
    sums = matches.groupBy(*keys).agg(
        F.sum("tp").alias("tp"),
        F.sum(F.col("n_pred") - F.col("tp")).alias("fp"),
        F.sum(F.col("n_truth") - F.col("tp")).alias("fn"),
        F.sum("distance").alias("_distance"),
    )
    return sums.withColumns(
        {
            "mae": F.try_divide(F.col("_distance").cast("double"), F.col("tp").cast("double")),
            "precision": precision(F.col("tp"), F.col("fp")),
            "sensitivity": recall(F.col("tp"), F.col("fn")),
        }
    ).drop("_distance")


def indel_density(indels: DataFrame, reads: DataFrame) -> DataFrame:
    """Indels per base of the read universe, per testset and accession."""
    bases = reads.groupBy("testset", "accession").agg(F.sum("length").alias("n_bases"))
    found = indels.groupBy("testset", "accession").agg(F.count("*").alias("n_indels"))
    n = F.coalesce("n_indels", F.lit(0))
    return bases.join(found, ["testset", "accession"], "left").select(
        "testset", "accession", n.alias("n_indels"), "n_bases", F.coalesce(F.try_divide(n.cast("double"), F.col("n_bases").cast("double")), F.lit(0.0)).alias("density")
    )


def with_genome_info(counts: DataFrame, genomes: DataFrame, gc_edges: tuple = C.GC_EDGES) -> DataFrame:
    """Counts with family, domain, gc_content, gc_bin and translation_table of their genome; NULLs if it has no row."""
    info = genomes.select(
        "accession",
        "family",
        "domain",
        "gc_content",
        C.gc_bin(F.col("gc_content"), gc_edges).alias("gc_bin"),
        C.translation_table(F.col("family")).alias("translation_table"),
    )
    return counts.join(info, "accession", "left")


def genomes_per_bin(genomes: DataFrame, gc_edges: tuple = C.GC_EDGES) -> DataFrame:
    """Genomes in each GC bin; those outside all bins have none."""
    return genomes.withColumn("gc_bin", C.gc_bin(F.col("gc_content"), gc_edges)).groupBy("gc_bin").agg(F.count("*").alias("n_genomes"))


def micro_totals(counts: DataFrame, sets: list[list[str]], counters: tuple[str, ...] = ("tp", "fp", "fn")) -> DataFrame:
    """Summed counters for several grouping sets at once; ``grouping_id`` tells a total from a NULL value."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return counts.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id().cast("int").alias("grouping_id"), *[F.sum(c).alias(c) for c in counters]
    )


def sweep(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and scores per condition: error level, read length, training size, platform or ablation."""
    return with_scores(counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def model_grid(scores: DataFrame, testsets: DataFrame, models: list[str]) -> DataFrame:
    """Every (testset, model) combination; missing scores are NULL."""
    return for_models(testsets, models).join(scores, ["testset", "model"], "left")


def metric_matrix(scores: DataFrame, metric: str, models: list[str]) -> DataFrame:
    """Genome by model, one metric, model columns in the given order."""
    return scores.groupBy("accession").pivot("model", models).agg(F.first(metric))


def mark_best(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Add is_best: the row holds its group's highest value; all rows of a tie are marked."""
    best = F.max(metric).over(Window.partitionBy(*keys))  # one row per model and condition
    return scores.withColumn("is_best", F.col(metric) == best)


def metric_range(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.min(metric).alias("min_value"), F.max(metric).alias("max_value"))


def family_report(genome_counts: DataFrame, metric, min_genomes: int, first_model: str) -> DataFrame:
    """Micro metric per family and model, its distances to the lowest and highest genome, and a family rank.

    ``genome_counts`` has accession, model, family, tp, fp, fn; ``metric`` maps (tp, fp, fn) columns to a column.
    Families need ``min_genomes`` genomes scored by ``first_model``, whose metric also ranks them.
    """
    score = metric(F.col("tp"), F.col("fp"), F.col("fn"))
    # Kept, one row per family and model, as the ranks read it again.
    grouped = checkpointed(
        genome_counts.withColumn("_score", score)
        .groupBy("family", "model")
        .agg(
            *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
            F.count("*").alias("n_genomes"),
            F.min("_score").alias("_low"),
            F.max("_score").alias("_high"),
        )
        .withColumn("value", score)
    )
    several = F.col("n_genomes") > 1
    bounds = grouped.withColumns(
        {
            "below": F.when(several, F.greatest(F.col("value") - F.col("_low"), F.lit(0.0))).otherwise(0.0),
            "above": F.when(several, F.greatest(F.col("_high") - F.col("value"), F.lit(0.0))).otherwise(0.0),
        }
    )
    # One row per family: their number is set by the taxonomy.
    lead = grouped.filter((F.col("model") == first_model) & (F.col("n_genomes") >= min_genomes))
    ranked = lead.select("family", F.row_number().over(Window.orderBy(F.desc("value"), "family")).alias("family_rank"))
    return bounds.join(ranked, "family").drop("_low", "_high")
