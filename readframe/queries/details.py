"""Smaller steps of the jobs, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from readframe.functions import cds as C
from readframe.functions import errors as E
from readframe.functions import sequence as S
from readframe.operators import datasets as DS
from readframe.operators import evaluate as V
from readframe.operators import taxonomy as X
from readframe.plans import truth_sets as TS
from readframe.queries.evaluation import _MATCHED, _SCORES, _counts, _rounded
from readframe.queries.genomes import _ORDER_WEIGHTS, _PROPORTIONAL, _QUOTAS, _WEIGHTED
from readframe.queries.registry import query
from readframe.queries.sequences import _MASKED
from readframe.sources import fasta

EDGES = (0, 30, 45, 60, 101)


@query(
    """
    select case when gc_content < 30 then '0-30' when gc_content < 45 then '30-45' when gc_content < 60 then '45-60' when gc_content < 101 then '60-101' end as gc_bin,
           count(*) as n_genomes from {genomes} group by 1"""
)
def genomes_per_gc_bin(t):
    """Genomes in GC bins with edges of one's own."""
    return V.genomes_per_bin(t("genomes"), EDGES)


@query(
    f"""
    with {_MATCHED},
    sums as (
      select case model when 'small' then 'no starts' when 'medium' then 'no stops' else 'all labels' end as ablation, testset,
             cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from genome_counts group by all)
    select *, {_SCORES} from sums"""
)
def ablation_sweep(t):
    """Scores per ablation, for which the models stand."""
    ablation = F.when(F.col("model") == "small", "no starts").when(F.col("model") == "medium", "no stops").otherwise("all labels")
    return _rounded(V.sweep(_counts(t).withColumn("ablation", ablation), ["ablation", "testset"]))


@query("select accession, family from {genomes} where substr(accession, length(accession)) <> '7' and family is not null")
def genomes_with_family(t):
    """Genomes whose family rank is known; those with a 7 at the end lose theirs first."""
    lost = F.endswith("accession", F.lit("7"))
    return X.with_family(t("genomes").withColumn("family", F.when(~lost, F.col("family")))).select("accession", "family")


@query("select accession as taxa, partition from {genomes}")
def tree_annotations(t):
    """Leaf annotations for a tree viewer."""
    return X.annotation_table(t("genomes"))


@query("select model, testset, count(*) as n from {pred} where \"end\" - start + 1 > 60 group by all")
def gene_caller_tier(t):
    """Gene-caller CDSs long enough to count."""
    return TS.gene_caller_main(t("pred")).groupBy("model", "testset").agg(F.count("*").alias("n"))


@query(
    """
    select p.model, p.read_name, p.start as p_start, p."end" as p_end, t.start as t_start, t."end" as t_end,
           round(case when p.rf = t.rf and (p."end" - p.start) + (t."end" - t.start) - greatest(least(p."end", t."end") - greatest(p.start, t.start), 0) > 0
                 then greatest(least(p."end", t."end") - greatest(p.start, t.start), 0) / ((p."end" - p.start) + (t."end" - t.start) - greatest(least(p."end", t."end") - greatest(p.start, t.start), 0))
                 else 0 end, 9) as iou
    from {pred} p join {truth} t on p.testset = t.testset and p.accession = t.accession and p.read_name = t.read_name
    where p.cds_group is null and t.cds_group is null"""
)
def span_ious(t):
    """Overlap over union of unbroken predictions and truths of one read."""
    keys = ["testset", "accession", "read_name"]
    p = t("pred").filter("cds_group is null").select("model", *keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("rf").alias("p_rf"))
    q = t("truth").filter("cds_group is null").select(*keys, F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("rf").alias("t_rf"))
    iou = C.span_iou(*[F.col(c) for c in ("p_start", "p_end", "p_rf", "t_start", "t_end", "t_rf")])
    return p.join(q, keys).select("model", "read_name", "p_start", "p_end", "t_start", "t_end", F.round(iou.cast("double"), 9).alias("iou"))


@query("select name, length(seq) % 3 = 0 as is_consistent from {reads}")
def frame_checks(t):
    """Does a read hold three bases per residue, its last partial codon counted as one?"""
    residues = F.repeat(F.lit("X"), F.ceil(F.length("seq") / 3).cast("int"))
    return t("reads").select("name", S.frame_is_consistent(F.col("seq"), residues).alias("is_consistent"))


@query("select name, reverse(translate(seq, 'ACGT', 'TGCA')) as seq from {reads}")
def minus_genomes(t):
    """A set of sequences, reverse-complemented."""
    return fasta.reverse_set(t("reads").select("name", "seq"))


@query(
    """
    select concat('r', l_orderkey, '.', l_linenumber) as read_name, 'truth' as side,
           array_to_string(list_filter([concat(10 + l_partkey % 100, 'I'), concat(60 + l_suppkey % 80, 'D'), '5I'],
             lambda x: cast(substr(x, 1, length(x) - 1) as int) between 20 and 20 + 3 * (l_linenumber * 10)), ',') as inside
    from {lineitem}"""
)
def indels_inside_cds(t):
    """Indel tokens of an error text that lie inside a CDS."""
    text = F.concat((F.col("l_partkey") % 100 + 10).cast("string"), F.lit("I"), (F.col("l_suppkey") % 80 + 60).cast("string"), F.lit("D5I"))
    low = F.lit(20)
    inside = E.indels_between(E.indel_tokens(text), low, low + 3 * (F.col("l_linenumber") * 10).cast("int"))
    name = F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return t("lineitem").select(name.alias("read_name"), F.lit("truth").alias("side"), F.array_join(inside, ",").alias("inside"))


@query(
    """
    select concat('r', l_orderkey, '.', l_linenumber) as read_name, cast((l_partkey + 40 + l_partkey + 41 + l_linenumber % 5) // 2 as int) as pos,
           case (l_linenumber % 3) when 1 then 'I' when 2 then 'D' end as kind
    from {lineitem} where l_linenumber % 3 <> 0"""
)
def gap_indels(t):
    """Predicted insertions and deletions: the middle of the gap where the frame changes."""
    from readframe.operators.frameshift import gap_indels as between

    def fragment(start, end, rf):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), rf.cast("int").alias("rf"))

    p, n = F.col("l_partkey"), F.col("l_linenumber")
    chain = F.array(fragment(p, p + 40, F.lit(0)), fragment(p + 41 + n % 5, p + 100, n % 3))
    name = F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("."), n.cast("string"))
    return t("lineitem").select(name.alias("read_name"), F.inline(between(chain)))


@query(
    f"""
    with {_MASKED}
    select name, cast(length(masked) as bigint) as n, cast(length(masked) - length(replace(masked, 'N', '')) as bigint) as n_unknown,
           cast(length(seq) - length(replace(seq, 'N', '')) as bigint) as n_before,
           len(list_filter(list_zip(string_split(seq, ''), string_split(masked, '')), lambda z: z[1] = z[2] or z[2] = 'N')) = length(masked) as is_same_elsewhere,
           len(list_filter(list_zip(string_split(seq, ''), string_split(masked, '')), lambda z: z[1] <> 'N' or z[2] = 'N')) = length(masked) as has_only_more_n
    from masked_reads"""
)
def base_masking_check(t):
    """How many bases masking leaves unknown in a read; the others equal the input, and no N is lost."""
    masked = S.mask_bases(F.col("seq"), F.col("name"), 42, 10_000)
    bases = F.zip_with(F.split("seq", ""), F.split("masked", ""), lambda a, b: F.struct(((b == "N") | (a == b)).alias("same"), ((a != "N") | (b == "N")).alias("kept")))
    rows = t("reads").select("name", "seq", masked.alias("masked")).withColumn("bases", bases)
    unknown = [(F.length(c) - F.length(F.translate(c, "N", ""))).cast("long").alias(n) for c, n in (("masked", "n_unknown"), ("seq", "n_before"))]
    flags = F.forall("bases", lambda x: x["same"]).alias("is_same_elsewhere"), F.forall("bases", lambda x: x["kept"]).alias("has_only_more_n")
    return rows.select("name", F.length("masked").cast("long").alias("n"), *unknown, *flags)


@query(
    f"""
    with {_WEIGHTED}, drawn as (select o_orderpriority, count(*) as drawn from chosen group by all),
    given as (select o_orderpriority, count(*) as given, any_value(weight) as weight from weighed group by all),
    shares as (select g.o_orderpriority, given, coalesce(drawn, 0) as drawn, coalesce(drawn, 0) / (given * weight) as share from given g left join drawn d on g.o_orderpriority = d.o_orderpriority)
    select cast(sum(drawn) as bigint) as n_drawn, sum(drawn) = sum(given) as all_known, max(share) < 2 * min(share) as in_proportion from shares"""
)
def weighted_sample_check(t):
    """As many draws as asked for, all of known orders, categories in the order of weight times size."""
    from readframe.queries.genomes import weighted_sample

    drawn = weighted_sample(t).groupBy("o_orderpriority").agg(F.count("*").alias("drawn"))
    given = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("given"))
    weight = F.create_map(*[F.lit(x) for kv in _ORDER_WEIGHTS.items() for x in kv])[F.col("o_orderpriority")]
    both = given.join(drawn, "o_orderpriority", "left").withColumn("share", F.coalesce("drawn", F.lit(0)) / (F.col("given") * weight))
    return both.agg(
        F.sum("drawn").alias("n_drawn"), (F.sum("drawn") == F.sum("given")).alias("all_known"), (F.max("share") < 2 * F.min("share")).alias("in_proportion")
    )


@query(
    f"""
    with {_QUOTAS}, {_PROPORTIONAL}
    select count(*) as n, count(*) filter (accession in (select accession from both_ends)) = 2 as has_extremes from sample"""
)
def proportional_sample_check(t):
    """A hundred genomes, both GC extremes among them."""
    from readframe.queries.genomes import proportional_sample

    sample, ends = proportional_sample(t), DS.gc_extremes(t("genomes")).withColumn("is_end", F.lit(1))
    return sample.join(ends, "accession", "left").agg(F.count("*").alias("n"), (F.sum("is_end") == 2).alias("has_extremes"))
