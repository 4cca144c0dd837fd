"""Predictions against truth, and the reports on top."""

from __future__ import annotations

from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions import metrics as M
from readframe.operators import evaluate as V
from readframe.operators import stats as T
from readframe.plans import truth_sets as TS
from readframe.queries.inputs import MODELS, READ_LENGTH
from readframe.queries.registry import query

READ_KEYS = ["testset", "accession", "read_name"]

# Whole CDSs with fragments as text, one row per CDS (broken: rf -1).
_WHOLE = """
    pred_whole as (
      select model, testset, accession, read_name, start, "end", rf as code, 1 as parts from {pred} where cds_group is null
      union all
      select model, testset, accession, read_name, min(start), max("end"), case when count(*) > 1 then -1 else min(rf) end, count(*)
      from {pred} where cds_group is not null group by model, testset, accession, read_name, cds_group),
    truth_whole as (
      select testset, accession, read_name, start, "end", rf as code, 1 as parts from {truth} where cds_group is null
      union all
      select testset, accession, read_name, min(start), max("end"), case when count(*) > 1 then -1 else min(rf) end, count(*)
      from {truth} where cds_group is not null group by testset, accession, read_name, cds_group),
    models as (select unnest(['small', 'medium', 'large']) as model)"""
_MATCHED = f"""{_WHOLE},
    p as (select model, testset, accession, read_name, start, "end", code, count(*) as n_pred from pred_whole group by all),
    t as (select model, testset, accession, read_name, start, "end", code, count(*) as n_truth from truth_whole, models group by all),
    matched as (
      select coalesce(p.model, t.model) as model, coalesce(p.testset, t.testset) as testset, coalesce(p.accession, t.accession) as accession,
             coalesce(p.read_name, t.read_name) as read_name, coalesce(n_pred, 0) as n_pred, coalesce(n_truth, 0) as n_truth,
             least(coalesce(n_pred, 0), coalesce(n_truth, 0)) as tp
      from p full join t on p.model = t.model and p.testset = t.testset and p.accession = t.accession and p.read_name = t.read_name
       and p.start = t.start and p."end" = t."end" and p.code = t.code),
    read_counts as (
      select model, testset, accession, read_name, cast(sum(tp) as bigint) as tp, cast(sum(n_pred - tp) as bigint) as fp, cast(sum(n_truth - tp) as bigint) as fn
      from matched group by all),
    genome_counts as (
      select model, testset, accession, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn
      from read_counts group by all)"""
_SCORES = """round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
      round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1"""


def _whole(t):
    truth = V.for_models(V.whole_cds(t("truth"), READ_KEYS), MODELS)
    return truth, V.whole_cds(t("pred"), V.READ)


def _sides(t):
    """Whole CDSs with the truth once for all models."""
    return V.whole_cds(t("truth"), READ_KEYS), V.whole_cds(t("pred"), V.READ)


def _counts(t, keys=V.GENOME):
    return V.exact_match_counts_by_model(*_sides(t), MODELS, keys)


@query(f"with {_MATCHED} select *, {_SCORES} from genome_counts")
def exact_match_metrics(t):
    """Counts and scores per model, testset and genome for exact matches."""
    return M.with_scores(_counts(t), digits=6)


@query(f"with {_MATCHED} select * from read_counts")
def read_match_counts(t):
    return _counts(t, V.READ)


_GENOME_INFO = """
    info as (
      select accession, family, domain, gc_content, case when gc_content < 40 then '0-40' when gc_content < 50 then '40-50'
             when gc_content < 60 then '50-60' when gc_content < 100 then '60-100' end as gc_bin from {genomes})"""


@query(
    f"""
    with {_MATCHED}, {_GENOME_INFO},
    sums as (
      select model, domain, gc_bin, cast(grouping(model, domain, gc_bin) as int) as grouping_id, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn
      from genome_counts c join info i on c.accession = i.accession group by grouping sets ((model, domain, gc_bin), (model, gc_bin), (model)))
    select *, {_SCORES} from sums"""
)
def gc_bin_rollup(t):
    """Precision, recall and F1 per model, domain and GC bin, with totals."""
    counts = V.with_genome_info(_counts(t), t("genomes"))
    totals = V.micro_totals(counts, [["model", "domain", "gc_bin"], ["model", "gc_bin"], ["model"]])
    return M.with_scores(totals, digits=6)


@query(
    f"""
    with {_MATCHED}, tables as (select accession, case when family = 'NATION_7' then 4 else 11 end as translation_table from {{genomes}}),
    sums as (select model, translation_table, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn
             from genome_counts c join tables i on c.accession = i.accession where translation_table <> 4 group by all)
    select *, {_SCORES} from sums"""
)
def translation_table_totals(t):
    """Totals without genomes of translation table 4, for which one family of the test data stands."""
    family = F.when(F.col("family") == "NATION_7", C.TABLE_FOUR_FAMILIES[0]).otherwise(F.col("family"))
    counts = V.with_genome_info(_counts(t), t("genomes").withColumn("family", family)).filter("translation_table != 4")
    sums = counts.groupBy("model", "translation_table").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return M.with_scores(sums, digits=6)


@query(
    f"""
    with {_MATCHED}, scored as (select *, {_SCORES} from genome_counts)
    select model, testset, min(f1) as min_value, max(f1) as max_value from scored group by all"""
)
def genome_metric_range(t):
    return V.metric_range(M.with_scores(_counts(t), digits=6), ["model", "testset"], "f1")


@query(
    f"""
    with {_MATCHED},
    sums as (select cast(regexp_extract(testset, '([0-9.e-]+)i_', 1) as double) as indel_rate, cast(regexp_extract(testset, 'i_([0-9.e-]+)s', 1) as double) as substitution_rate,
                    cast(regexp_extract(testset, '(\\d+)bp$', 1) as int) as read_length, model,
                    cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from genome_counts group by all)
    select *, {_SCORES} from sums"""
)
def error_level_sweep(t):
    """Totals per nominal error level, read length and model."""
    from readframe.functions import errors as E

    indel, substitution = E.nominal_rates(F.col("testset"))
    named = _counts(t, ["model", "testset"]).select(
        indel.alias("indel_rate"), substitution.alias("substitution_rate"), E.nominal_read_length(F.col("testset")).alias("read_length"),
        "model", "tp", "fp", "fn",
    )
    return _rounded(V.sweep(named, ["indel_rate", "substitution_rate", "read_length", "model"]))


@query(
    f"""
    with {_MATCHED}, sizes as (select * from (values ('small', 100), ('medium', 200), ('large', 400)) s(model, n_training_genomes)),
    sums as (select testset, n_training_genomes, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn
             from genome_counts c join sizes s on c.model = s.model group by all)
    select *, {_SCORES} from sums"""
)
def training_size_sweep(t):
    """F1 per testset and number of training genomes."""
    size = F.when(F.col("model") == "small", 100).when(F.col("model") == "medium", 200).otherwise(400)
    counts = _counts(t, ["model", "testset"]).withColumn("n_training_genomes", size)
    return _rounded(V.sweep(counts, ["testset", "n_training_genomes"]))


def _rounded(scores):
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""
    with {_MATCHED}, platforms as (select o_orderkey, o_orderpriority as platform from {{orders}}),
    sums as (select platform, model, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn
             from read_counts c join platforms p on c.read_name = concat('r', p.o_orderkey) group by all)
    select *, {_SCORES} from sums"""
)
def platform_sweep(t):
    """Scores per sequencing platform, for which the order priority stands."""
    platforms = t("orders").select(F.concat(F.lit("r"), "o_orderkey").alias("read_name"), F.col("o_orderpriority").alias("platform"))
    return _rounded(V.sweep(_counts(t, V.READ).join(platforms, "read_name"), ["platform", "model"]))


@query(
    f"""
    with {_MATCHED}, {_GENOME_INFO},
    scored as (select c.*, family, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as s 
               from (select model, accession, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from genome_counts group by all) c join info i on c.accession = i.accession),
    fam as (select family, model, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, count(*) as n_genomes, min(s) as low, max(s) as high from scored group by all),
    val as (select *, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as v from fam),
    lead as (select family, cast(row_number() over (order by v desc, family) as int) as family_rank from val where model = 'small' and n_genomes >= 2)
    select v.family, model, tp, fp, fn, n_genomes, round(v, 6) as value, round(case when n_genomes > 1 then greatest(v - low, 0) else 0 end, 6) as below,
           round(case when n_genomes > 1 then greatest(high - v, 0) else 0 end, 6) as above, family_rank
    from val v join lead l on v.family = l.family"""
)
def family_report(t):
    info = t("genomes").select("accession", "family")
    counts = _counts(t, ["model", "accession"]).join(info, "accession")
    report = V.family_report(counts, M.f1, min_genomes=2, first_model="small")
    return report.withColumns({c: F.round(c, 6) for c in ("value", "below", "above")})


@query(
    f"""
    with {_MATCHED}, scored as (select model, testset, accession, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from genome_counts),
    r as (select model, testset, f1 as v from scored),
    q as (select model, testset, count(*) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as minimum, max(v) as maximum,
                 quantile_cont(v, 0.25) as q1, median(v) as median, quantile_cont(v, 0.75) as q3 from r group by all)
    select q.model, q.testset, any_value(n) as n, round(any_value(mean), 6) as mean, round(any_value(std), 6) as std, round(any_value(minimum), 6) as minimum, round(any_value(maximum), 6) as maximum,
           round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3, round(min(v), 6) as whisker_low, round(max(v), 6) as whisker_high
    from q join r on q.model = r.model and q.testset = r.testset where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by q.model, q.testset"""
)
def metric_box_numbers(t):
    """Spread of the genome F1 values behind a box plot."""
    box = T.box_numbers(M.with_scores(_counts(t)), ["model", "testset"], "f1")
    return box.withColumns({c: F.round(c, 6) for c in ("mean", "std", "minimum", "maximum", "q1", "median", "q3", "whisker_low", "whisker_high")})


@query(
    f"""
    with {_MATCHED}, scored as (select accession, model, {_SCORES} from (select accession, model, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from genome_counts group by all))
    select accession, max(f1) filter (where model = 'small') as small, max(f1) filter (where model = 'medium') as medium, max(f1) filter (where model = 'large') as large
    from scored group by accession"""
)
def metric_matrix(t):
    return V.metric_matrix(M.with_scores(_counts(t, ["accession", "model"]), digits=6), "f1", MODELS)


@query(
    f"""
    with {_MATCHED}, sums as (select testset, model, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from genome_counts group by all),
    scored as (select testset, model, {_SCORES} from sums)
    select g.testset, m.model, precision, recall, f1
    from (select distinct testset from {{read_universe}}) g cross join (select unnest(['small', 'medium', 'large', 'huge']) as model) m
    left join scored s on s.testset = g.testset and s.model = m.model"""
)
def model_grid(t):
    """Scores of every testset and model; a model without predictions shows NULL."""
    scores = M.with_scores(_counts(t, ["testset", "model"]), digits=6).drop("tp", "fp", "fn")
    testsets = t("read_universe").select("testset").distinct()
    return V.model_grid(scores, testsets, [*MODELS, "huge"])


@query(
    f"""
    with {_MATCHED}, scored as (select testset, model, {_SCORES} from (select testset, model, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from genome_counts group by all))
    select testset, model, f1, f1 = max(f1) over (partition by testset) as is_best from scored"""
)
def best_models(t):
    scores = M.with_scores(_counts(t, ["testset", "model"]), digits=6).select("testset", "model", "f1")
    return V.mark_best(scores, ["testset"], "f1")


_CODONS = """
    spans as (
      select 'p' as side, model, testset, accession, read_name, start, "end", rf from {pred}
      union all select 't', model, testset, accession, read_name, start, "end", rf from {truth}, (select unnest(['small', 'medium', 'large']) as model)),
    covered as (
      select distinct side, model, testset, accession, read_name, rf, unnest(range((start - 1 - rf) // 3, ("end" - rf) // 3)) as codon from spans),
    cells as (
      select model, testset, accession, read_name, rf, codon, max(case when side = 'p' then 1 else 0 end) as p, max(case when side = 't' then 1 else 0 end) as t
      from covered where codon < 99 group by all),
    hits as (
      select model, testset, accession, sum(p * t) as tp, sum(p * (1 - t)) as fp, sum(t * (1 - p)) as fn from cells group by all),
    sizes as (select testset, accession, 3 * 99 * count(*) as n_codons from {read_universe} group by all)"""


@query(
    f"""
    with {_CODONS},
    counts as (
      select m.model, s.testset, s.accession, cast(coalesce(tp, 0) as bigint) as tp, cast(coalesce(fp, 0) as bigint) as fp, cast(coalesce(fn, 0) as bigint) as fn, n_codons
      from sizes s cross join (select unnest(['small', 'medium', 'large']) as model) m
      left join hits h on h.testset = s.testset and h.accession = s.accession and h.model = m.model)
    select model, testset, accession, tp, fp, fn, cast(n_codons - tp - fp - fn as bigint) as tn from counts"""
)
def codon_confusion(t):
    truth, pred = V.whole_cds(t("truth"), READ_KEYS), V.whole_cds(t("pred"), V.READ)
    return V.codon_confusion(truth, pred, t("read_universe"), MODELS)


@query(
    f"""
    with {_CODONS},
    sums as (select h.model, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from hits h group by all),
    total as (select sum(n_codons) as n from sizes),
    counts as (select model, cast(tp as double) as tp, cast(fp as double) as fp, cast(fn as double) as fn, cast(n - tp - fp - fn as double) as tn from sums, total)
    select model, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1,
           round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) as mcc from counts"""
)
def codon_scores(t):
    """Codon-level precision, recall, F1 and Matthews correlation per model."""
    truth, pred = V.whole_cds(t("truth"), READ_KEYS), V.whole_cds(t("pred"), V.READ)
    counts = V.codon_confusion(truth, pred, t("read_universe"), MODELS)
    sums = counts.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    mcc = F.round(M.mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]), 6)
    return M.with_scores(sums, digits=6).select("model", "precision", "recall", "f1", mcc.alias("mcc"))


@query(
    f"""
    with {_WHOLE},
    codons as (
      select 'p' as side, model, testset, accession, read_name, 'start' as kind, start as pos, code from pred_whole where not (case when code < 0 then start between 1 and 3 else start = code + 1 end)
      union all select 'p', model, testset, accession, read_name, 'stop', "end", code from pred_whole where "end" < 298
      union all select 't', model, testset, accession, read_name, 'start', start, code from truth_whole, models where not (case when code < 0 then start between 1 and 3 else start = code + 1 end)
      union all select 't', model, testset, accession, read_name, 'stop', "end", code from truth_whole, models where "end" < 298),
    cells as (select model, testset, accession, read_name, kind, pos, code, max(case side when 'p' then 1 else 0 end) as p, max(case side when 't' then 1 else 0 end) as t from codons group by all)
    select model, testset, accession, kind, cast(sum(p * t) as bigint) as tp, cast(sum(p * (1 - t)) as bigint) as fp, cast(sum(t * (1 - p)) as bigint) as fn from cells group by all"""
)
def start_stop_detection(t):
    return V.boundary_counts_by_model(*_sides(t), MODELS, F.lit(READ_LENGTH))


# Greedy matches as a walk over the pairs of a read in the order of choice.
_GREEDY = """
    walk as (
      select *, row_number() over (partition by k order by o1, o2, o3) as rn from pairs),
    greedy(k, rn, used_p, used_t, n, dist) as (
      select k, 0 :: bigint, [] :: bigint[], [] :: bigint[], 0, 0 :: double from (select distinct k from walk)
      union all
      select g.k, g.wrn, case when free then list_append(used_p, pi) else used_p end, case when free then list_append(used_t, ti) else used_t end,
             n + case when free then 1 else 0 end, dist + case when free then d else 0 end
      from (select g.*, w.rn as wrn, w.pi, w.ti, w.d, not list_contains(used_p, w.pi) and not list_contains(used_t, w.ti) as free
            from greedy g join walk w on w.k = g.k and w.rn = g.rn + 1) g),
    done as (select k, max(n) as n, max(dist) as dist from greedy group by k)"""


_INDELS = f"""
    tt as (
      select concat(model, '|', testset, '|', accession, '|', read_name) as k, pos, row_number() over (partition by model, testset, accession, read_name order by pos) as ti
      from {{true_indels}}, (select unnest(['small', 'medium', 'large']) as model)),
    pp as (
      select concat(model, '|', testset, '|', accession, '|', read_name) as k, pos, row_number() over (partition by model, testset, accession, read_name order by pos) as pi
      from {{called_indels}}),
    pairs as (select tt.k, ti, pi, abs(tt.pos - pp.pos) as d, abs(tt.pos - pp.pos) as o1, ti as o2, pi as o3 from tt join pp on tt.k = pp.k),
    {_GREEDY},
    sides as (select k, sum(n_t) as n_truth, sum(n_p) as n_pred from (select k, 1 as n_t, 0 as n_p from tt union all select k, 0, 1 from pp) group by k)"""


@query(
    f"""
    with {_INDELS}
    select split_part(s.k, '|', 1) as model, split_part(s.k, '|', 2) as testset, split_part(s.k, '|', 3) as accession, split_part(s.k, '|', 4) as read_name,
           cast(n_truth as bigint) as n_truth, cast(n_pred as bigint) as n_pred, cast(coalesce(n, 0) as bigint) as tp, cast(coalesce(dist, 0) as bigint) as distance,
           case when n_pred = 0 then 'truth only' when n_truth = 0 then 'prediction only' else 'both' end as side
    from sides s left join done d on s.k = d.k""",
    recursive=True,
)
def indel_matches(t):
    """Closest-first matches of true and called indel positions per read."""
    return V.indel_matches(V.for_models(t("true_indels"), MODELS), t("called_indels"))


@query(
    f"""
    with {_INDELS},
    sums as (
      select split_part(s.k, '|', 1) as model, split_part(s.k, '|', 2) as testset, split_part(s.k, '|', 3) as accession, sum(coalesce(n, 0)) as tp,
             sum(n_pred - coalesce(n, 0)) as fp, sum(n_truth - coalesce(n, 0)) as fn, sum(coalesce(dist, 0)) as dist
      from sides s left join done d on s.k = d.k group by all)
    select model, testset, accession, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, case when tp > 0 then round(dist / tp, 6) end as mae,
           round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as sensitivity
    from sums""",
    recursive=True,
)
def indel_scores(t):
    """Indel counts, mean distance, precision and sensitivity per genome."""
    scores = V.indel_metrics(V.indel_matches(V.for_models(t("true_indels"), MODELS), t("called_indels")))
    return scores.withColumns({c: F.round(c, 6) for c in ("mae", "precision", "sensitivity")})


@query(
    """
    select u.testset, u.accession, coalesce(any_value(i.n), 0) as n_indels, cast(sum(length) as bigint) as n_bases, round(coalesce(any_value(i.n), 0) / sum(length), 9) as density
    from {read_universe} u left join (select testset, accession, count(*) as n from {true_indels} group by all) i on i.testset = u.testset and i.accession = u.accession
    group by u.testset, u.accession"""
)
def indel_density(t):
    density = V.indel_density(t("true_indels"), t("read_universe"))
    return density.withColumn("density", F.round("density", 9))


# IoU of whole CDSs by fragments; one row per CDS and per fragment.
_IOU = """
    t_rows as (select m.model, t.testset, t.accession, t.read_name, coalesce(t.cds_group, '-') as g, t.start, t."end", t.rf, row_number() over () as line from {truth} t, (select unnest(['small', 'medium', 'large']) as model) m),
    p_rows as (select model, testset, accession, read_name, coalesce(cds_group, '-') as g, start, "end", rf, row_number() over () as line from {pred}),
    t_frag as (select concat(model, '|', testset, '|', accession, '|', read_name) as k, case when g = '-' then concat('s', line) else g end as c, start, "end", rf from t_rows),
    p_frag as (select concat(model, '|', testset, '|', accession, '|', read_name) as k, case when g = '-' then concat('s', line) else g end as c, start, "end", rf from p_rows),
    t_cds as (select k, c, count(*) as parts, sum("end" - start) as len, min(start) as s, max("end") as e, min(rf) as rf, list(start order by start) as fs from t_frag group by all),
    p_cds as (select k, c, count(*) as parts, sum("end" - start) as len, min(start) as s, max("end") as e, min(rf) as rf, list(start order by start) as fs from p_frag group by all),
    ti as (select *, row_number() over (partition by k order by parts > 1, s, e, fs, case when parts = 1 then rf else 0 end, c) as ti from t_cds),
    pi as (select *, row_number() over (partition by k order by parts > 1, s, e, fs, case when parts = 1 then rf else 0 end, c) as pi from p_cds),
    shared as (
      select p.k, p.c as pc, t.c as tc, sum(greatest(least(p."end", t."end") - greatest(p.start, t.start), 0)) as inter
      from p_frag p join t_frag t on p.k = t.k and p.rf = t.rf group by all),
    own as (select p.k, p.c as pc, t.c as tc, sum(t."end" - t.start) as own_len from p_cds p join t_frag t on p.k = t.k and p.rf = t.rf where p.parts = 1 group by all),
    scored as (
      select s.k, pi.pi, ti.ti, inter, inter / (pi.len + case when pi.parts = 1 and ti.parts > 1 then own_len else ti.len end - inter) as iou
      from shared s join pi on pi.k = s.k and pi.c = s.pc join ti on ti.k = s.k and ti.c = s.tc left join own o on o.k = s.k and o.pc = s.pc and o.tc = s.tc
      where inter > 0),
    pairs as (select k, pi, ti, 0 as d, pi as o1, -iou as o2, ti as o3 from scored where iou >= 0.8)"""


@query(
    f"""
    with {_IOU}, {_GREEDY},
    sides as (select k, sum(n_t) as n_truth, sum(n_p) as n_pred from (select k, 1 as n_t, 0 as n_p from ti union all select k, 0, 1 from pi) group by k),
    counts as (select split_part(s.k, '|', 1) as model, split_part(s.k, '|', 2) as testset, n_truth, n_pred, coalesce(n, 0) as n from sides s left join done d on s.k = d.k)
    select model, testset, cast(sum(n) as bigint) as tp, cast(sum(n_pred - n) as bigint) as fp, cast(sum(n_truth - n) as bigint) as fn from counts group by all""",
    recursive=True,
)
def iou_match_counts(t):
    """Counts of one-to-one matches with at least 0.8 overlap over union."""
    return V.iou_match_counts(*_whole(t), 0.8, ["model", "testset"])


@query(
    f"""
    with {_MATCHED}, {_GENOME_INFO}, scored as (select c.model, domain, gc_content, {_SCORES} from genome_counts c join info i on c.accession = i.accession),
    ranked as (
      select model, domain, rank() over (partition by model, domain order by gc_content) + (count(*) over (partition by model, domain, gc_content) - 1) / 2 as rx,
             rank() over (partition by model, domain order by f1) + (count(*) over (partition by model, domain, f1) - 1) / 2 as ry from scored),
    rho as (select model, domain, corr(rx, ry) as r, count(*) as n from ranked group by all having count(*) >= 3)
    select model, domain, n, round(r, 6) as rho, round(r * sqrt((n - 2) / (1 - r * r)), 4) as t_statistic from rho"""
)
def gc_rank_correlation(t):
    """Rank correlation of GC and F1 over genomes per model and domain."""
    counts = V.with_genome_info(_counts(t), t("genomes"))
    rho = T.spearman(M.with_scores(counts, digits=6), ["model", "domain"], "gc_content", "f1")
    return rho.withColumns({"rho": F.round("rho", 6), "t_statistic": F.round("t_statistic", 4)})


@query(
    f"""
    with {_MATCHED}, {_GENOME_INFO}, scored as (select c.model, gc_content, {_SCORES} from genome_counts c join info i on c.accession = i.accession)
    select model, round(regr_slope(f1, gc_content), 8) as slope, round(regr_intercept(f1, gc_content), 6) as intercept from scored group by model"""
)
def gc_trend(t):
    counts = V.with_genome_info(_counts(t), t("genomes"))
    line = T.least_squares(M.with_scores(counts, digits=6), ["model"], "gc_content", "f1")
    return line.withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6)})


_PAIRS = """
    present as (select distinct testset, accession, model from read_counts),
    shared as (select a.testset as ts, a.accession as acc, a.model as ma, b.model as mb from present a join present b on a.testset = b.testset and a.accession = b.accession
               where (a.model, b.model) in (('small', 'medium'), ('small', 'large'), ('medium', 'large'))),
    enough as (select ts as t0, ma as a0, mb as b0 from shared group by all having count(*) >= 5),
    sums as (
      select ts as testset, ma as model_a, mb as model_b, sum(case when model = ma then tp end) as a_tp, sum(case when model = ma then fp end) as a_fp, sum(case when model = ma then fn end) as a_fn,
             sum(case when model = mb then tp end) as b_tp, sum(case when model = mb then fp end) as b_fp, sum(case when model = mb then fn end) as b_fn
      from shared join enough on ts = t0 and ma = a0 and mb = b0 join read_counts c on c.testset = ts and c.accession = acc and model in (ma, mb) group by all),
    observed as (select testset, model_a, model_b, 2 * a_tp / (2 * a_tp + a_fp + a_fn) as f1_a, 2 * b_tp / (2 * b_tp + b_fp + b_fn) as f1_b from sums)"""


@query(f"with {_MATCHED}, {_PAIRS} select testset, model_a, model_b, round(f1_a, 6) as f1_a, round(f1_b, 6) as f1_b, round(f1_a - f1_b, 6) as difference from observed")
def paired_differences(t):
    """F1 of every two models over the genomes both have scored."""
    pairs = T.observed_differences(_counts(t, V.READ), MODELS)
    return pairs.select("testset", "model_a", "model_b", *[F.round(c, 6).alias(c) for c in ("f1_a", "f1_b", "difference")])


# Of n reads with equal count differences as many swap as coins show heads, 120 coins from one hash.
_SWAPS = f"""
    sides as (
      select ts as testset, ma as model_a, mb as model_b, acc, read_name,
             sum(case when model = mb then tp else -tp end) as tp, sum(case when model = mb then fp else -fp end) as fp, sum(case when model = mb then fn else -fn end) as fn
      from shared join enough on ts = t0 and ma = a0 and mb = b0 join read_counts c on c.testset = ts and c.accession = acc and model in (ma, mb) group by all),
    deltas as (select testset, model_a, model_b, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, count(*) as n from sides where tp <> 0 or fp <> 0 or fn <> 0 group by all),
    coins as (select *, least(120, n - 120 * block) as k from (select *, unnest(range(0, (n - 1) // 120 + 1)) as block from deltas)),
    hashes as (select *, md5(concat_ws(':', 42, testset, model_a, model_b, tp, fp, fn, block, permutation)) as h from (select *, unnest(range(0, 1000)) as permutation from coins)),
    heads as (
      select *, bit_count(cast(concat('0x', substr(h, 1, 15)) as bigint) & ((1 :: bigint << least(k, 60) :: int) - 1))
              + bit_count(cast(concat('0x', substr(h, 16, 15)) as bigint) & ((1 :: bigint << greatest(k - 60, 0) :: int) - 1)) as swapped from hashes),
    moved as (select testset, model_a, model_b, permutation, sum(tp * swapped) as d_tp, sum(fp * swapped) as d_fp, sum(fn * swapped) as d_fn from heads group by all),
    permuted as (
      select o.testset, o.model_a, o.model_b,
             abs(2 * (a_tp + d_tp) / (2 * (a_tp + d_tp) + a_fp + d_fp + a_fn + d_fn) - 2 * (b_tp - d_tp) / (2 * (b_tp - d_tp) + b_fp - d_fp + b_fn - d_fn)) >= abs(f1_a - f1_b) as is_extreme
      from moved m join sums s on m.testset = s.testset and m.model_a = s.model_a and m.model_b = s.model_b join observed o on o.testset = s.testset and o.model_a = s.model_a and o.model_b = s.model_b),
    tests as (
      select o.testset, o.model_a, o.model_b, any_value(f1_a) as f1_a, any_value(f1_b) as f1_b, greatest(coalesce(count(*) filter (is_extreme) / count(is_extreme), 1), 0.001) as p_value
      from observed o left join permuted p on o.testset = p.testset and o.model_a = p.model_a and o.model_b = p.model_b group by o.testset, o.model_a, o.model_b),
    ranked as (select *, count(*) over (partition by testset) - row_number() over (partition by testset order by p_value, model_a, model_b) + 1 as factor from tests)"""


@query(
    f"""
    with {_MATCHED}, {_PAIRS}, {_SWAPS}
    select testset, model_a, model_b, round(f1_a, 6) as f1_a, round(f1_b, 6) as f1_b, round(f1_a - f1_b, 6) as difference, round(p_value, 6) as p_value,
           round(least(max(p_value * factor) over (partition by testset order by p_value, model_a, model_b rows unbounded preceding), 1), 6) as p_holm
    from ranked"""
)
def permutation_test(t):
    """Paired permutation test of every two models with corrected p values."""
    tests = T.permutation_test(_counts(t, V.READ), MODELS)
    held = T.holm(tests, ["testset"], ["model_a", "model_b"])
    return held.withColumns({c: F.round(c, 6) for c in ("f1_a", "f1_b", "difference", "p_value", "p_holm")})


_P_VALUES = """
    tests as (select l_returnflag as testset, concat('m', l_linenumber) as model_a, l_linestatus as model_b, (cast(sum(l_quantity) as bigint) % 97 + 1) / cast(970 as double) as p_value
              from {lineitem} group by all),
    ranked as (select *, count(*) over (partition by testset) - row_number() over (partition by testset order by p_value, model_a, model_b) + 1 as factor from tests),
    held as (select *, least(max(p_value * factor) over (partition by testset order by p_value, model_a, model_b rows unbounded preceding), 1) as p_holm from ranked)"""


def _held(t):
    p = (F.sum("l_quantity").cast("long") % 97 + 1) / F.lit(970.0)
    tests = t("lineitem").groupBy(
        F.col("l_returnflag").alias("testset"), F.concat(F.lit("m"), "l_linenumber").alias("model_a"), F.col("l_linestatus").alias("model_b")
    ).agg(p.alias("p_value"))
    return T.holm(tests, ["testset"], ["model_a", "model_b"])


@query(f"with {_P_VALUES} select testset, model_a, model_b, round(p_value, 9) as p_value, round(p_holm, 9) as p_holm from held")
def holm_correction(t):
    return _held(t).select("testset", "model_a", "model_b", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"))


@query(
    f"""
    with {_P_VALUES}, texts as (select model_a, model_b, testset, case when p_holm <= 0.1 then '<0.1' else format('{{:.3f}}', p_holm) end as txt from held)
    select model_a, model_b, max(txt) filter (where testset = 'A') as "A", max(txt) filter (where testset = 'N') as "N", max(txt) filter (where testset = 'R') as "R" from texts group by all"""
)
def pair_report(t):
    """Corrected p values by model pair and testset, with a floor of one in ten."""
    return T.pair_report(_held(t), ["A", "N", "R"], n_permutations=10)


_LABEL_PAIRS = """
    flat as (
      select * from (
        select l.name, d.source as seq_desc, unnest(rf1_labels) as x, unnest(rf2_labels) as y from {labelled} l join {documents} d on l.name = concat('d', d.doc_id))
      where x is not null and y is not null),
    seqs as (select name, seq_desc, avg(case when x = y then 1.0 else 0 end) as acc, count(*) filter (where x = y) = count(*) as perfect from flat group by all),
    cells as (select seq_desc, x, y, count(*) as n from flat group by all union all select '(all)', x, y, count(*) from flat group by x, y),
    mt as (select seq_desc, sum(n * n) as v from (select seq_desc, x, sum(n) as n from cells group by all) group by all),
    mp as (select seq_desc, sum(n * n) as v from (select seq_desc, y, sum(n) as n from cells group by all) group by all),
    mx as (select a.seq_desc, sum(a.n * b.n) as v from (select seq_desc, x, sum(n) as n from cells group by all) a join (select seq_desc, y, sum(n) as n from cells group by all) b on a.seq_desc = b.seq_desc and a.x = b.y group by all),
    tot as (select seq_desc, sum(n) as s, sum(case when x = y then n else 0 end) as c from cells group by all),
    mcc as (select tot.seq_desc, (cast(c as double) * s - mx.v) / (sqrt(cast(s as double) * s - mt.v) * sqrt(cast(s as double) * s - mp.v)) as mcc
            from tot join mt on mt.seq_desc = tot.seq_desc join mp on mp.seq_desc = tot.seq_desc join mx on mx.seq_desc = tot.seq_desc),
    grouped as (
      select seq_desc, count(*) as n, avg(case when perfect then 1.0 else 0 end) as fp, avg(case when acc > 0.9 then 1.0 else 0 end) as fh, avg(acc) as a from seqs group by seq_desc
      union all select '(all)', count(*), avg(case when perfect then 1.0 else 0 end), avg(case when acc > 0.9 then 1.0 else 0 end), avg(acc) from seqs)"""


@query(
    f"""
    with {_LABEL_PAIRS}
    select case when g.seq_desc = '(all)' then null else g.seq_desc end as seq_desc, g.seq_desc = '(all)' as is_total, n as n_sequences,
           round(fp, 6) as fraction_perfect, round(fh, 6) as fraction_high, round(a, 6) as accuracy, round(mcc, 6) as mcc
    from grouped g join mcc on g.seq_desc = mcc.seq_desc"""
)
def sequence_accuracy(t):
    """Accuracy and Matthews correlation of label arrays per sequence type; two frames stand for truth and prediction."""
    both = F.least(F.size("rf1_labels"), F.size("rf2_labels"))
    same = t("labelled").withColumns({c: F.slice(c, F.lit(1), both) for c in ("rf1_labels", "rf2_labels")}).filter("size(rf1_labels) > 0")
    types = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.col("source").alias("seq_desc"))
    pairs = same.join(types, "name").select("seq_desc", F.col("rf1_labels").alias("true_labels"), F.col("rf2_labels").alias("predicted_labels"))
    out = T.sequence_accuracy(pairs)
    return out.withColumns({c: F.round(c, 6) for c in ("fraction_perfect", "fraction_high", "accuracy", "mcc")})


@query(
    """
    select event_type as category, round(sum(coalesce(value, 0) * (1 + user_id % 7)) / sum(1 + user_id % 7), 6) as mean_loss from {events} group by all"""
)
def weighted_loss(t):
    batches = t("events").select(
        F.col("event_type").alias("category"), F.coalesce("value", F.lit(0.0)).alias("loss"), (F.col("user_id") % 7 + 1).alias("n")
    )
    return T.weighted_loss(batches).withColumn("mean_loss", F.round("mean_loss", 6))


_TRUTH_TIERS = """
    spans as (select testset, accession, read_name, coalesce(cds_group, concat('s', start, '-', "end", '-', rf, '-', n)) as g, min(start) as low, max("end") as high, count(*) as parts
              from (select *, row_number() over (partition by testset, accession, read_name, start, "end", rf, cds_group is null order by cds_group) as n from {truth}) group by all)"""


@query(
    f"""
    with {_TRUTH_TIERS}
    select 'main' as tier, testset, accession, read_name, count(*) as n_cds, cast(sum(parts) as bigint) as n_fragments from spans where high - low + 1 > 60 group by all
    union all select 'wide', testset, accession, read_name, count(*), cast(sum(parts) as bigint) from spans where high - low + 1 > 30 group by all"""
)
def truth_tiers(t):
    """CDSs and fragments per read and length tier, through the labelled-read form."""
    truth = t("truth")
    # Single CDSs get groups of their own: their place among the read's rows.
    rows = truth.withColumn("_g", F.coalesce("cds_group", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"))))
    item = F.struct("start", "end", "rf", F.col("_g").alias("cds_group"))
    reads = rows.groupBy(*READ_KEYS).agg(F.array_sort(F.collect_list(item)).alias("cds_coords")).withColumn("indel_positions", F.lit(None).cast("string"))
    tiers = TS.truth_cds(reads)
    return tiers.groupBy("tier", *READ_KEYS).agg(F.count("*").alias("n_cds"), F.sum(F.size("fragments")).cast("long").alias("n_fragments"))


@query(
    """
    with whole as (
      select model, testset, accession, read_name, "end" - start + 1 as len, 1 as parts from {pred} where cds_group is null
      union all select model, testset, accession, read_name, sum("end" - start + 1), count(*) from {pred} where cds_group is not null group by model, testset, accession, read_name, cds_group)
    select 'main' as tier, model, testset, count(*) as n_cds, cast(sum(parts) as bigint) as n_fragments, cast(sum(len) as bigint) as n_bases from whole where len > 60 group by all
    union all select 'wide', model, testset, count(*), cast(sum(parts) as bigint), cast(sum(len) as bigint) from whole where len > 30 or (parts = 1 and len = 30) group by all"""
)
def prediction_tiers(t):
    tiers = TS.predicted_cds(t("pred"))
    length = F.aggregate("fragments", F.lit(0), lambda acc, f: acc + f["end"] - f["start"] + 1)
    return tiers.groupBy("tier", "model", "testset").agg(
        F.count("*").alias("n_cds"), F.sum(F.size("fragments")).cast("long").alias("n_fragments"), F.sum(length).cast("long").alias("n_bases")
    )
