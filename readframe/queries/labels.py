"""Label arrays: borders, runs, decoding, chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from readframe.functions import labels as L
from readframe.functions import sequence as S
from readframe.operators import datasets as DS
from readframe.operators import decode as D
from readframe.operators import frameshift as X
from readframe.operators import windows as W
from readframe.operators.scheme import LabelScheme
from readframe.plans import truth_sets as TS
from readframe.queries.registry import query
from readframe.queries.sequences import _scored
from readframe.session import measured

FRAMES = ("rf0_labels", "rf1_labels", "rf2_labels")

# One row per label with its neighbours.
_CELLS = """
    arrays as (select name, 0 as rf, rf0_labels as labels from {labelled} union all select name, 1, rf1_labels from {labelled}
               union all select name, 2, rf2_labels from {labelled}),
    flat as (select name, rf, unnest(labels) as label, generate_subscripts(labels, 1) - 1 as i from arrays),
    cells as (select *, lag(label) over w as prev, lead(label) over w as next from flat window w as (partition by name, rf order by i))"""


def _frames(t, fn):
    rows = F.transform(F.array(*[F.col(c) for c in FRAMES]), lambda labels, rf: F.struct(rf.alias("rf"), fn(labels, rf).alias("x")))
    return t("labelled").select("name", F.inline(rows))


@query(
    f"""
    with {_CELLS},
    opened as (select name, rf, i, case when label = 1 and prev = 0 then 4 else label end as label from cells),
    after as (select *, lead(label) over (partition by name, rf order by i) as next from opened)
    select name, rf, cast(case when label = 1 and next = 0 then 5 else label end as int) as label, count(*) as n, cast(sum(i) as bigint) as place_sum
    from after group by all"""
)
def indel_borders(t):
    """Labels after marking the borders: counts and position sums."""
    marked = _frames(t, lambda labels, rf: L.mark_indel_borders(labels))
    cells = marked.select("name", "rf", F.posexplode("x").alias("i", "label"))
    return cells.groupBy("name", "rf", F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.sum("i").cast("long").alias("place_sum")
    )


@query(
    f"""
    with {_CELLS},
    runs as (
      select *, sum(case when label in (1, 2, 4) and (prev is null or prev not in (1, 2, 4)) then 1 else 0 end) over (partition by name, rf order by i) as run
      from cells),
    bodies as (
      select name, rf, run, min(i) as first, max(i) as last, arg_min(label, i) as opening, arg_max(next, i) as closing
      from runs where label in (1, 2, 4) group by name, rf, run)
    select name, cast(3 * first + rf + 1 as int) as start, cast(3 * (last + 1 + case when closing in (3, 5) then 1 else 0 end) + rf as int) as "end",
           cast(rf as int) as frame, case opening when 2 then 'start_codon' when 4 then 'indel_start' else 'internal_region' end as start_type,
           case closing when 3 then 'stop_codon' when 5 then 'indel_stop' else 'internal_region' end as end_type
    from bodies"""
)
def label_segments(t):
    runs = L.in_all_frames(FRAMES, L.segments)
    return t("labelled").select("name", F.inline(runs))


@query(
    f"""
    with {_CELLS},
    marked as (
      select *, sum(case when label in (1, 2) and (prev is null or prev not in (1, 2)) or label = 3 and (prev is null or prev not in (1, 2)) then 1 else 0 end)
                over (partition by name, rf order by i) as run
      from cells)
    select name, cast(3 * min(i) + rf + 1 as int) as start, cast(3 * (max(i) + 1) + rf as int) as "end", cast(rf as int) as rf
    from marked where label in (1, 2, 3) group by name, rf, run"""
)
def truth_intervals(t):
    runs = L.in_all_frames(FRAMES, L.truth_intervals)
    return t("labelled").select("name", F.inline(runs))


@query(
    """
    select name, case when len(list_filter(list_concat(rf0_labels, list_concat(rf1_labels, rf2_labels)), lambda x: x in (1, 2, 3))) = 0 then 'no CDS' end as reason from {labelled}"""
)
def reads_by_cds(t):
    """Reads that can be truth, and why the others cannot."""
    runs = L.in_all_frames(FRAMES, L.truth_intervals)
    return TS.judged_by_cds(t("labelled").select("name", runs.alias("cds_coords"))).select("name", "reason")


@query(
    f"""
    with {_CELLS},
    runs as (select *, i - row_number() over (partition by name, rf, label order by i) as run from cells where rf = 0),
    coded as (select r.name, run, i, substr(seq, cast(i as int) * 3 + 1, 3) as x from runs r join {{labelled}} l on r.name = l.name where label = 1),
    residues as (
      select name, run, i, case when instr('TCAG', x[1]) > 0 and instr('TCAG', x[2]) > 0 and instr('TCAG', x[3]) > 0
             then replace(substr('{S.AMINO_ACIDS}', 16 * (instr('TCAG', x[1]) - 1) + 4 * (instr('TCAG', x[2]) - 1) + instr('TCAG', x[3]), 1), '*', 'X')
             else '<unk>' end as residue
      from coded)
    select name, fragment, count(*) as n from (select name, run, string_agg(residue, '' order by i) as fragment from residues group by name, run) group by all"""
)
def coding_fragments(t):
    fragments = L.coding_fragments(S.model_residues(F.col("seq")), F.col("rf0_labels"))
    rows = t("labelled").select("name", F.explode(fragments).alias("fragment"))
    return rows.groupBy("name", "fragment").agg(F.count("*").alias("n"))


@query(
    f"""
    with {_CELLS}
    select name, cast(i // 3 as int) as codon, cast(case when min(label) = 0 then 0 else arg_min(label, i) end as tinyint) as label
    from cells where rf = 0 group by name, i // 3"""
)
def codon_labels(t):
    """Base labels to codon labels, with the label array taken as one label per base."""
    return t("labelled").select("name", F.posexplode(L.codon_labels(F.col("rf0_labels"))).alias("codon", "label"))


@query(
    """
    with longest as (select accession, max(len(rf0_labels)) as n from {labelled} group by accession)
    select name, array_to_string(list_concat(rf0_labels, list_transform(range(len(rf0_labels), n), lambda x: -1)), ',') as padded, cast(len(rf0_labels) as int) as n_valid
    from {labelled} join longest using (accession)"""
)
def padded_labels(t):
    """Labels filled up to the longest read of each genome."""
    longest = t("labelled").groupBy("accession").agg(F.max(F.size("rf0_labels")).alias("longest"))
    padded = L.pad_labels(F.col("rf0_labels"), F.col("longest")).alias("k")
    rows = t("labelled").join(measured(longest), "accession").select("name", padded)
    return rows.select("name", F.array_join(F.col("k").cast("array<string>"), ",").alias("padded"), F.size(L.valid_labels(F.col("k"))).alias("n_valid"))


@query(
    """
    select name, cast(greatest(case when list_position(rf0_labels, 2) > 0 then list_position(rf0_labels, 2) - 2 else len(rf0_labels) end, 1) as int) as asked,
           cast(least(greatest(case when list_position(rf0_labels, 2) > 0 then list_position(rf0_labels, 2) - 2 else len(rf0_labels) end, 1), len(rf1_labels)) as int) as kept
    from {labelled}"""
)
def labels_to_eos(t):
    """Labels up to the end token, for which label 2 of frame 0 stands."""
    tokens = F.transform("rf0_labels", lambda x: x.cast("int"))
    kept = L.trim_at_eos(F.col("rf1_labels"), tokens, 2)
    position = F.array_position(tokens, 2)
    asked = F.greatest(F.when(position > 0, position - 2).otherwise(F.size(tokens)), F.lit(1)).cast("int")
    return t("labelled").select("name", asked.alias("asked"), F.size(kept).alias("kept"))


# Step scores of the four single labels: illegal -10, legal -0.5, and 0 -> 0 free.
_SINGLE = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
_STEPS = np.where(np.array([[b in L.LEGAL_FOUR[a] for b in range(4)] for a in range(4)]), -0.5, -10.0)
_STEPS[0, 0] = 0.0
_STEP_SQL = " union all ".join(f"select {a} as a, {b} as b, {_STEPS[a, b]} as w" for a in range(4) for b in range(4))


@query(
    f"""
    with cells as (
      select read_name, window_start // 3 + (k - 1) // 4 as codon, (k - 1) % 4 as label, cast(embedding[k] as double) as v
      from {{window_scores}}, (select unnest(range(1, 65)) as k)),
    scores as (select read_name, codon, list(v order by label) as s from (select read_name, codon, label, avg(v) as v from cells where codon < 40 group by all) group by all),
    steps as ({_STEP_SQL}),
    lengths as (select read_name, max(codon) + 1 as n from scores group by all),
    path(read_name, codon, best, back) as (
      select read_name, codon, s, [] :: int[][] from scores where codon = 0
      union all
      select p.read_name, p.codon + 1,
             list_transform([0, 1, 2, 3], lambda b: list_max(list_transform([0, 1, 2, 3], lambda a: p.best[a + 1] + w[4 * a + b + 1])) + s.s[b + 1]),
             list_append(p.back, list_transform([0, 1, 2, 3], lambda b: cast(list_position(
                list_transform([0, 1, 2, 3], lambda a: p.best[a + 1] + w[4 * a + b + 1]),
                list_max(list_transform([0, 1, 2, 3], lambda a: p.best[a + 1] + w[4 * a + b + 1]))) - 1 as int)))
      from path p join scores s on s.read_name = p.read_name and s.codon = p.codon + 1, (select list(w order by a, b) as w from steps)),
    ends as (select p.read_name, back, cast(list_position(best, list_max(best)) - 1 as int) as label, l.n - 1 as codon
             from path p join lengths l on p.read_name = l.read_name and p.codon = l.n - 1),
    walk(read_name, back, label, codon) as (
      select * from ends
      union all select read_name, back, back[cast(codon as bigint)][label + 1], codon - 1 from walk where codon > 0)
    select read_name, cast(codon as int) as codon, cast(label as tinyint) as label from walk""",
    recursive=True,
)
def decoded_labels(t):
    """Best label path of every read through its merged window scores."""
    merged = W.merge_window_scores(_scored(t), 4)
    decoded = D.decode_paths(W.score_matrix(merged), _STEPS)
    labelled = D.frame_label_columns(decoded, _SINGLE)
    return labelled.select("read_name", F.posexplode("rf0_labels").alias("codon", "label"))


_CLASSES = """
    triples as (
      select distinct a as rf0, b as rf1, c as rf2 from (
        select unnest(rf0_labels) as a, unnest(rf1_labels) as b, unnest(rf2_labels) as c from {labelled}) where a is not null and b is not null and c is not null),
    classes as (select cast(row_number() over (order by rf0, rf1, rf2) - 1 as int) as class_id, rf0, rf1, rf2 from triples)"""
_LEGAL = " or ".join(f"({{0}} = {a} and {{1}} in ({', '.join(map(str, b))}))" for a, b in L.LEGAL_FOUR.items())


@query(
    f"""
    with {_CLASSES}
    select x.class_id as from_id, y.class_id as to_id,
           ({_LEGAL.format("x.rf0", "y.rf0")}) and ({_LEGAL.format("x.rf1", "y.rf1")}) and ({_LEGAL.format("x.rf2", "y.rf2")}) as is_legal
    from classes x cross join classes y"""
)
def legal_transitions(t):
    return D.legal_transitions(DS.number_triples(DS.label_triples(t("labelled"))), n_labels=4)


_BORDERED_CLASSES = f"""{_CELLS.replace("cells as", "beside as")},
    bordered as (select name, rf, i, case when label = 1 and prev = 0 then 4 when label = 1 and next = 0 then 5 else label end as label from beside),
    broken as (select distinct a.label as rf0, b.label as rf1, c.label as rf2 from bordered a join bordered b on a.name = b.name and a.i = b.i and a.rf = 0 and b.rf = 1 join bordered c on a.name = c.name and a.i = c.i and c.rf = 2),
    broken_classes as (select cast(row_number() over (order by rf0, rf1, rf2) - 1 as int) as class_id, rf0, rf1, rf2 from broken)"""
_LEGAL_STEPS = {"S": L.LEGAL_FOUR, "SI": L.LEGAL_SIX}


def _step_sql(variant: str, classes: str) -> str:
    follows = " or ".join(f"({{0}} = {a} and {{1}} in ({', '.join(map(str, b))}))" for a, b in _LEGAL_STEPS[variant].items())
    legal = " and ".join(f"({follows.format(f'x.rf{r}', f'y.rf{r}')})" for r in range(3))
    free = "x.class_id = y.class_id and x.rf0 + x.rf1 + x.rf2 <= 1 and greatest(x.rf0, x.rf1, x.rf2) <= 1"
    return f"""select '{variant}' as variant, x.class_id as from_id, y.class_id as to_id, concat(x.rf0, x.rf1, x.rf2) as labels,
      cast(case when {free} then 0 when {legal} then -0.5 else -10 end as double) as score from {classes} x cross join {classes} y"""


@query(f"with {_CLASSES}, {_BORDERED_CLASSES} {_step_sql('S', 'classes')} union all {_step_sql('SI', 'broken_classes')}")
def scheme_steps(t):
    """Classes and step scores of two variants, learned from the labelled reads: with and without borders at indels."""
    spark, rows = t("labelled").sparkSession, []
    for variant in ("S", "SI"):
        scheme = LabelScheme.of_reads(t("labelled"), variant)
        steps = scheme.steps(-0.5)
        rows += [(variant, a, b, "".join(map(str, x)), float(steps[a, b])) for a, x in enumerate(scheme.classes) for b in range(len(scheme.classes))]
    return spark.createDataFrame(rows, "variant string, from_id int, to_id int, labels string, score double")


# Six labels, one coding frame at a time.
_LABEL_SCHEME = [(0, 0, 0)] + [tuple(label if rf == at else 0 for rf in range(3)) for at in range(3) for label in range(1, 6)]


# Segments of labels with marked borders; k is a segment's place in its read.
_RUN_SEGMENTS = """
    runs as (
      select *, sum(case when label in (1, 2, 4) and (prev is null or prev not in (1, 2, 4)) then 1 else 0 end) over (partition by name, rf order by i) as run
      from {beside}),
    bodies as (
      select name, rf, run, min(i) as first, max(i) as last, arg_min(label, i) as opening, arg_max(next, i) as closing
      from runs where label in (1, 2, 4) group by name, rf, run),
    segs as (
      select name, cast(3 * first + rf + 1 as int) as start, cast(3 * (last + 1 + case when closing in (3, 5) then 1 else 0 end) + rf as int) as "end",
             cast(rf as int) as frame, case opening when 2 then 'start_codon' when 4 then 'indel_start' else 'internal_region' end as start_type,
             case closing when 3 then 'stop_codon' when 5 then 'indel_stop' else 'internal_region' end as end_type
      from bodies),
    placed as (select *, row_number() over (partition by name order by start, frame) as k from segs)"""
_MARKED_SEGMENTS = f"""{_CELLS},
    bordered as (select name, rf, i, case when label = 1 and prev = 0 then 4 when label = 1 and next = 0 then 5 else label end as label from cells),
    beside as (select *, lag(label) over w as prev, lead(label) over w as next from bordered window w as (partition by name, rf order by i)),
    {_RUN_SEGMENTS.replace("{beside}", "beside").strip()}"""

# A walk over the segments of a read; each row carries the chains that wait for a further segment.
_LINKED = f"""
    walk(name, k, first, fragment, open) as (
      select name, k, k, 0, case when end_type = 'indel_stop' then [{{'first': k, 'last': k, 'n': 1, 'end': "end", 'frame': frame}}] else [] end from placed where k = 1
      union all
      select name, k, coalesce(fit['first'], k), coalesce(fit['n'], 0),
             case when end_type = 'indel_stop' then list_append(rest, {{'first': coalesce(fit['first'], k), 'last': k, 'n': coalesce(fit['n'], 0) + 1, 'end': "end", 'frame': frame}}) else rest end
      from (
        select name, k, "end", frame, end_type, fit, list_filter(waiting, lambda o: fit is null or o['first'] <> fit['first']) as rest
        from (
          select *, list_sort(list_filter(waiting, lambda o: abs(start - o['end']) <= {X.MAX_LINK_DISTANCE} and start_type = 'indel_start' and frame <> o['frame']))[1] as fit
          from (
            select p.*, list_filter(w.open, lambda o: o['n'] = 1 and p.start - o['end'] <= {X.MAX_LINK_DISTANCE} or o['last'] = p.k - 1) as waiting
            from walk w join placed p on p.name = w.name and p.k = w.k + 1) a) b) c),
    members as (select p.*, w.first, w.fragment, count(*) over (partition by p.name, w.first) as parts from placed p join walk w on p.name = w.name and p.k = w.k),
    linked as (
      select *, dense_rank() over (partition by name order by first) as group_id, lead(frame) over c as frame_after, lag(frame) over c as frame_before,
             lead(start) over c as start_after, lead("end") over c as end_after
      from members where parts > 1 window c as (partition by name, first order by fragment)),
    settled(name, first, fragment, start) as (
      select name, first, fragment, start from linked where fragment = 0
      union all
      select l.name, l.first, l.fragment + 1, case when {{cut}} then cut_start else start_after end
      from (select l.*, s.start as cut_from, s.start + 3 * cast(floor((start_after - s.start) / 3) as int) - 1 as cut_end, start_after + 3 * cast(floor(("end" - start_after + 3) / 3) as int) as cut_start
            from settled s join linked l on l.name = s.name and l.first = s.first and l.fragment = s.fragment) l
      where start_after is not null),
    chained as (
      select l.name, l.k, s.start, case when {{cut}} then cut_end else "end" end as "end", frame, start_type, end_type, group_id, l.fragment,
             case when (coalesce(frame_after, frame) - case when frame_after is null then frame_before else frame end + 3) % 3 = 1 then 'insertion' else 'deletion' end as indel_type
      from (select l.*, s.start + 3 * cast(floor((start_after - s.start) / 3) as int) - 1 as cut_end, start_after + 3 * cast(floor(("end" - start_after + 3) / 3) as int) as cut_start, s.start as cut_from
            from settled s join linked l on l.name = s.name and l.first = s.first and l.fragment = s.fragment) l
      join settled s on l.name = s.name and l.first = s.first and l.fragment = s.fragment),
    single as (select *, row_number() over (partition by name, "end" - start >= 30 order by start, frame) as n from members where parts = 1),
    segments as (
      select name, start, "end", frame, start_type, end_type, indel_type, cast(group_id as int) as group_id, cast(fragment as int) as fragment, cast(null as int) as number from chained
      union all
      select name, start, "end", frame, start_type, end_type, null, null, null, cast(case when "end" - start >= 30 then n end as int) from single)""".replace(
    "{cut}", '(start_after is not null and "end" >= start_after and cut_end >= cut_from and cut_start <= end_after)'
)


@query(f"with {_MARKED_SEGMENTS}, {_LINKED} select * from segments", recursive=True)
def chained_segments(t):
    """Label runs of each read with indel borders marked, chained over frameshifts."""
    runs = L.in_all_frames(FRAMES, lambda labels, rf: L.segments(L.mark_indel_borders(labels), rf))
    chained = X.chain_segments(t("labelled").select("name", runs.alias("segments")), min_length=30)
    return chained.select("name", F.inline("segments"))


# Fragments in order; each row carries the chains that may still go on, with their last fragment.
_CHAINED_TRUTH = f"""{_CELLS},
    marked as (
      select *, sum(case when label in (1, 2) and (prev is null or prev not in (1, 2)) or label = 3 and (prev is null or prev not in (1, 2)) then 1 else 0 end)
                over (partition by name, rf order by i) as run
      from cells),
    runs as (
      select name, cast(3 * min(i) + rf + 1 as int) as start, cast(3 * (max(i) + 1) + rf as int) as "end", cast(rf as int) as rf
      from marked where label in (1, 2, 3) group by name, rf, run),
    placed as (
      select r.*, row_number() over (partition by r.name order by start, "end", rf) as k, length,
             list_transform([0, 1, 2], lambda f: (length - f) // 3 * 3) as labelled_to
      from runs r join {{labelled}} l on r.name = l.name),
    walk(name, k, start, "end", rf, chain, n_chains, open) as (
      select name, k, start, "end", rf, 0, 1, [{{'chain': 0, 'end': "end", 'rf': rf}}] from placed where k = 1
      union all
      select name, k, start, "end", rf, coalesce(fit, n_chains), n_chains + case when fit is null then 1 else 0 end,
             list_append(list_filter(open, lambda o: o['chain'] <> coalesce(fit, -1) and o['end'] >= start - {X.MAX_FRAGMENT_GAP + 1}), {{'chain': coalesce(fit, n_chains), 'end': "end", 'rf': rf}})
      from (select p.name, p.k, p.start, p."end", p.rf, w.n_chains, w.open,
                   list_min(list_transform(list_filter(w.open, lambda o: p.start - o['end'] - 1 between 0 and {X.MAX_FRAGMENT_GAP} and p.rf <> o['rf']
                     and o['end'] < p.labelled_to[o['rf'] + 1] and p.start < p.labelled_to[p.rf + 1]), lambda o: o['chain'])) as fit
            from walk w join placed p on p.name = w.name and p.k = w.k + 1) x)"""


@query(f"""with {_CHAINED_TRUTH} select name, start, "end", rf, cast(chain as int) as cds_group from walk""", recursive=True)
def truth_chains(t):
    """Truth intervals of each read chained over small gaps."""
    runs = L.in_all_frames(FRAMES, L.truth_intervals)
    chained = X.chain_truth_fragments(t("labelled").select("name", "length", runs.alias("cds_coords")))
    return chained.select("name", F.inline("cds_coords"))
