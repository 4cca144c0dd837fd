"""Training data sets: label classes, samples, splits and their reports."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readframe.functions import errors as E
from readframe.functions import labels as L
from readframe.functions import sequence as S
from readframe.functions.draws import DRAW_BITS, draw
from readframe.operators.decode import class_of
from readframe.operators.scan import exact_quantiles, number_rows, same_keys, smallest_per_stratum

FRAMES = ("rf0", "rf1", "rf2")
LABELS = [f"{f}_labels" for f in FRAMES]
# Shares that steer the validation families.
FIRST_FAMILIES, VALIDATION_SHARE, ENOUGH, TOO_MUCH = 0.12, 0.10, 0.95, 1.10


def draw63(*parts: Column) -> Column:
    """Non-negative draw over the range of 63 bits from a row's own key, the same on every attempt of a task."""
    return F.shiftleft(draw(*parts), 63 - DRAW_BITS)


def label_classes(reads: DataFrame) -> DataFrame:
    """class_id, rf0, rf1, rf2: the distinct label triples after indel borders are marked, ids in sorted order.

    Frames of one read differ in length by up to one codon; all are cut to the shortest.  There are at most 6^3 triples,
    so the numbering window is small.
    """
    return number_triples(label_triples(reads.withColumns({c: L.mark_indel_borders(F.col(c)) for c in LABELS})))


def label_triples(reads: DataFrame) -> DataFrame:
    """rf0, rf1, rf2: the distinct label triples of all reads, as far as all three frames go.

    A triple is told apart as one number: an array's distinct numbers are found by hash, structs one against all others.
    """
    common = F.least(*[F.size(c) for c in LABELS])
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), common).alias(f) for f, c in zip(FRAMES, LABELS)])

    def number(triple):
        # A label is a tinyint, or absent.
        first, second, third = (F.coalesce(triple[f].cast("tinyint").cast("int") + 128, F.lit(256)) for f in FRAMES)
        return (first * 257 + second) * 257 + third

    # A plain explode makes Spark filter by the size of its array first, which would make the numbers a second time.
    found = reads.select(F.explode_outer(F.array_distinct(F.transform(zipped, number))).alias("_n")).filter("_n is not null").distinct()
    digits = [F.pmod(F.floor(F.col("_n") / 257**power), F.lit(257)) for power in (2, 1, 0)]
    kinds = [reads.schema[c].dataType.elementType for c in LABELS]
    return found.select(*[F.when(d != 256, d - 128).cast(kind).alias(f) for f, d, kind in zip(FRAMES, digits, kinds)])


def number_triples(triples: DataFrame) -> DataFrame:
    """Add class_id, dense in sorted order."""
    return triples.select((F.row_number().over(Window.orderBy(*FRAMES)) - 1).alias("class_id"), *FRAMES)


def describe_reads(reads: DataFrame, read_length: int, with_errors: bool = True) -> DataFrame:
    """Add seq_desc and mark indel borders in the labels of reads that have an indel."""
    has_indel = E.count_indels(F.col("indel_positions")) > 0
    substituted = F.lit(with_errors) & ~F.coalesce(F.col("MD") == str(read_length), F.lit(False))
    desc = L.sequence_type([F.col(c) for c in LABELS], has_indel, F.size("cds_coords") > 0, substituted)
    marked = {c: F.when(has_indel, L.mark_indel_borders(F.col(c))).otherwise(F.col(c)) for c in LABELS}
    return reads.withColumn("seq_desc", desc).withColumns(marked)


def model_dataset(
    reads: DataFrame,
    classes: list[tuple[int, int, int]],
    read_length: int,
    training: bool,
    with_errors: bool = True,
    seed: int = 42,
    per_million: int = 100,
) -> DataFrame:
    """Frame sequences of one length, labels and class ids per labelled read.

    Training reads get N at a hash-drawn share of their bases, and ``<unk>`` for the residues above them.  A row whose
    label triple has no class keeps a NULL in label_encodings; ``consistent`` tells whether all lengths agree.
    """
    described = describe_reads(reads, read_length, with_errors)
    read = S.mask_bases(F.col("read"), F.col("read_name"), seed, per_million) if training else F.col("read")
    base = described.withColumn("_read", read)
    codons = F.size("rf1_labels")
    out = {"accession": F.col("accession"), "read_name": F.col("read_name")}
    for frame, name in enumerate(FRAMES):
        nt = S.equal_length_frame(F.col("_read"), frame)
        residues = F.substr(f"{name}_seq", F.lit(1), codons)
        out[f"{name}_seq_nt"] = nt
        out[f"{name}_seq_aa"] = S.mask_residues(nt, residues) if training else residues
        out[f"{name}_labels"] = F.slice(f"{name}_labels", F.lit(1), codons)
    triples = F.arrays_zip(*[out[f"{name}_labels"].alias(name) for name in FRAMES])
    out["label_encodings"] = F.transform(triples, lambda t: class_of(classes, t["rf0"], t["rf1"], t["rf2"]))
    out["seq_desc"] = F.col("seq_desc")
    sizes = [F.size(out[f"{name}_labels"]) == codons for name in FRAMES]
    lengths = [F.length(f"{name}_seq") >= codons for name in FRAMES]
    out["consistent"] = sizes[0] & sizes[1] & sizes[2] & lengths[0] & lengths[1] & lengths[2]
    return base.select(*[value.alias(name) for name, value in out.items()])


def type_shares(rows: DataFrame) -> DataFrame:
    """Count and share of each seq_desc."""
    counts = rows.groupBy("seq_desc").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def fraction_per_stratum(rows: DataFrame, strata: list[str], fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows of every stratum (halves to even); ``key`` is unique per row."""
    sizes = rows.groupBy(*strata).agg(F.bround(F.count("*") * F.lit(fraction)).cast("long").alias("_quota"))
    joined = rows.join(sizes, strata)
    return smallest_per_stratum(joined, strata, "_quota", draw63(F.lit(seed), F.col(key)), key).drop("_quota")


def weighted_with_replacement(
    rows: DataFrame, category: str, weights: dict[str, float], n_draws: int, key: str, seed: int = 42
) -> DataFrame:
    """``n_draws`` rows drawn with replacement, each with probability proportional to its category's weight.

    A draw picks a category by its total weight, then a row number in it; rows are numbered without a global sort, and
    the draws, a distributed range, meet them by an equi-join on (category, number).  Only the counts of the weighted
    categories come to the driver.  Categories lie on the range of a draw in the order of their names, cut in whole
    numbers, so that no rounding decides.
    """
    counted = rows.filter(F.col(category).isin(*weights)).groupBy(category).agg(F.count("*").alias("n")).collect()
    counts = {row[category]: row["n"] for row in counted if weights[row[category]] > 0}
    shares = {name: Fraction(str(weights[name])) * n for name, n in sorted(counts.items())}
    slot, upto = F.lit(None).cast("struct<name:string,n:bigint>"), sum(shares.values())
    total = upto
    for name, share in reversed(shares.items()):
        here = F.struct(F.lit(name).alias("name"), F.lit(counts[name]).cast("bigint").alias("n"))
        slot = here if upto == total else F.when(F.col("_u") < int(2**DRAW_BITS * upto / total), here).otherwise(slot)
        upto -= share
    u, v = (draw(F.lit(seed + i), F.col("id")) for i in range(2))
    draws = rows.sparkSession.range(n_draws).select(F.col("id").alias("draw_id"), u.alias("_u"), v.alias("_v"))
    number = F.pmod("_v", "_slot.n")
    placed = draws.withColumn("_slot", slot).select("draw_id", F.col("_slot.name").alias(category), number.alias("_number"))
    numbered = number_rows(rows, [category], draw63(F.lit(seed + 2), F.col(key)), key, "_number")
    return placed.join(numbered, [category, "_number"]).drop("_number")


def family_stats(genomes: DataFrame) -> DataFrame:
    """domain, family, n, mean_gc and the 0-based GC rank of the family in its domain (one row per family)."""
    stats = genomes.groupBy("domain", "family").agg(F.count("*").alias("n"), F.avg("gc_content").alias("mean_gc"))
    by_gc = Window.partitionBy("domain").orderBy("mean_gc", "family")
    return stats.withColumn("gc_rank", F.row_number().over(by_gc) - 1)


def validation_families(genomes: DataFrame) -> DataFrame:
    """(domain, family) of the validation set.

    Per domain, 12% of the families are taken evenly along GC.  If they hold under 95% of a tenth of the genomes,
    families far from the chosen ones follow, as long as the set stays within 110%.  The fold runs over the family
    list of a domain, which the taxonomy bounds, never over genomes.
    """
    listed = family_stats(genomes).groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gc_rank", "family", "n"))), lambda f: f).alias("_families"),
        F.sum("n").alias("_total"),
    )
    count = F.size("_families")
    take = F.greatest(F.lit(1), F.floor(count * FIRST_FAMILIES)).cast("int")
    first = F.array_distinct(F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.floor(i * count / take).cast("int")))
    target = F.col("_total") * VALIDATION_SHARE
    base = listed.withColumn("_first", first).withColumn("_target", target)
    chosen = F.filter("_families", lambda f: F.array_contains(F.col("_first"), f["gc_rank"]))
    others = F.filter("_families", lambda f: ~F.array_contains(F.col("_first"), f["gc_rank"]))

    def distance(f: Column) -> Column:
        return F.array_min(F.transform("_first", lambda i: F.abs(i - f["gc_rank"])))

    by_distance = F.transform(
        F.array_sort(F.transform(others, lambda f: F.struct((-distance(f)).alias("d"), f["gc_rank"].alias("gc_rank"), f.alias("f")))),
        lambda x: x["f"],
    )
    start = F.struct(F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, f: acc + f["n"]).alias("n"), chosen.alias("picked"))

    def step(state: Column, f: Column) -> Column:
        wanted = (state["n"] < F.col("_target") * ENOUGH) & (state["n"] + f["n"] <= F.col("_target") * TOO_MUCH)
        grown = F.struct((state["n"] + f["n"]).alias("n"), F.concat(state["picked"], F.array(f)).alias("picked"))
        return F.when(wanted, grown).otherwise(state)

    picked = F.aggregate(by_distance, start, step, lambda state: state["picked"])
    return base.select("domain", F.explode(picked).alias("f")).select("domain", "f.family")


def split_by_family(genomes: DataFrame, test_seeds: DataFrame) -> DataFrame:
    """Add partition train / val / test such that no family is in two of them.

    Every family of a seed accession goes to test as a whole.
    """
    test_families = genomes.join(test_seeds.select("accession").distinct(), "accession", "left_semi").select("family").distinct()
    remaining = genomes.join(test_families, "family", "left_anti")
    val = validation_families(remaining).withColumn("_val", F.lit(True))
    test = genomes.join(test_families, "family", "left_semi").withColumn("partition", F.lit("test"))
    rest = remaining.join(val, ["domain", "family"], "left").withColumn(
        "partition", F.when(F.col("_val"), "val").otherwise("train")
    )
    return test.unionByName(rest.select(*test.columns))


def partition_label(genomes: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Add partition by membership in accession lists; ``none`` for accessions in no list.

    An accession in several lists belongs to the last of them.
    """
    tagged = None
    for place, (name, accessions) in enumerate(lists.items()):
        part = accessions.select("accession", F.struct(F.lit(place).alias("place"), F.lit(name).alias("name")).alias("list"))
        tagged = part if tagged is None else tagged.unionByName(part)
    last = tagged.groupBy("accession").agg(F.max("list")["name"].alias("partition"))
    return genomes.drop("partition").join(last, "accession", "left").withColumn("partition", F.coalesce("partition", F.lit("none")))


def gc_extremes(genomes: DataFrame) -> DataFrame:
    """Accessions with the lowest and the highest GC; the lowest accession on ties."""
    low = F.min(F.struct("gc_content", "accession"))
    high = F.min(F.struct((-F.col("gc_content")).alias("g"), F.col("accession")))
    ends = genomes.agg(F.array(low["accession"], high["accession"]).alias("a"))
    return ends.select(F.explode(F.array_distinct("a")).alias("accession"))


def family_quotas(genomes: DataFrame, target: int) -> DataFrame:
    """family, n, quota: shares of ``target`` proportional to family size, at least 1 for families of GC extremes.

    Rounding is to even; what is then missing or too much is spread by the fractional parts, one each in turn.
    """
    extremes = genomes.join(gc_extremes(genomes), "accession", "left_semi").select("family").distinct()
    sizes = genomes.groupBy("family").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    exact = F.col("n") / total * target
    marked = sizes.join(extremes.withColumn("_extreme", F.lit(True)), "family", "left").withColumn("_extreme", F.coalesce("_extreme", F.lit(False)))
    rounded = marked.withColumn("_exact", exact).withColumn("_quota", F.bround("_exact").cast("long"))
    rounded = rounded.withColumn("_quota", F.when(F.col("_extreme"), F.greatest("_quota", F.lit(1))).otherwise(F.col("_quota")))
    everything = Window.partitionBy()
    rounded = rounded.withColumn("_diff", F.lit(target) - F.sum("_quota").over(everything))
    in_turn = F.col("_quota") > 0
    rounded = rounded.withColumn("_slots", F.sum(in_turn.cast("long")).over(everything))
    fraction = F.col("_exact") - F.floor("_exact")
    # Families are few; this window ranks family rows.
    turn = Window.partitionBy("_turns").orderBy(F.when(F.col("_diff") > 0, -fraction).otherwise(fraction), F.desc("n"), "family")
    ranked = rounded.withColumn("_turns", in_turn).withColumn("_rank", F.row_number().over(turn) - 1)
    amount = F.abs("_diff")
    share = F.floor(amount / F.col("_slots")) + (F.col("_rank") < F.pmod(amount, F.col("_slots"))).cast("long")
    floor = F.col("_extreme").cast("long")
    changed = F.when(F.col("_diff") > 0, F.col("_quota") + share).otherwise(F.greatest(F.col("_quota") - share, floor))
    return ranked.select("family", "n", F.when(in_turn, changed).otherwise(F.col("_quota")).cast("long").alias("quota"))


def proportional_subsample(genomes: DataFrame, target: int, seed: int = 1) -> DataFrame:
    """``target`` genomes (all, if there are fewer) with family shares kept and both GC extremes always in.

    Families give their quota by hash draw; what is short is filled from the rest with weights proportional to family
    size, what is too much is dropped by draw, never an extreme.
    """
    extremes = gc_extremes(genomes).withColumn("_extreme", F.lit(True))
    # One row per family: the mean over genomes of their family's size.
    mean_size = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    quotas = family_quotas(genomes, target).withColumn("_mean_size", mean_size)
    drawn = (
        genomes.join(extremes, "accession", "left")
        .join(quotas.select("family", F.col("n").alias("_size"), F.col("quota").alias("_family_quota"), "_mean_size"), "family")
        .withColumn("_key", draw63(F.lit(seed), F.col("accession")))
        .withColumn("_first_key", F.when(F.col("_extreme"), F.lit(0)).otherwise(F.col("_key")))
    )
    own = smallest_per_stratum(drawn, ["family"], "_family_quota", F.col("_first_key"), "accession").select("accession", F.lit(True).alias("_own"))
    marked = drawn.join(own, "accession", "left")
    # Exponential race: the smallest -ln(u)/weight wins.  The distribution of a mean weight spreads it over 59 bits.
    uniform = (draw63(F.lit(seed + 1), F.col("accession")) + 1) / F.lit(float(2**63))
    race = ((1 - F.exp(F.ln(uniform) / F.col("_size") * F.col("_mean_size"))) * F.lit(float(2**59 - 1))).cast("long")
    random_order = F.shiftrightunsigned("_key", 4)
    tier = F.when(F.col("_extreme"), F.lit(0)).when(F.col("_own"), F.lit(1)).otherwise(F.lit(2)).cast("long")
    inside = F.when(F.col("_own") | F.col("_extreme"), random_order).otherwise(race)
    order = tier * F.lit(2**60) + inside
    ranked = marked.withColumns({"_target": F.lit(target), "_all": F.lit(0)})
    return smallest_per_stratum(ranked, ["_all"], "_target", order, "accession").select(*genomes.columns)


def sample_report(sample: DataFrame, population: DataFrame) -> DataFrame:
    """One row that describes a sample: size, families, GC spread, family sizes, domain shares before and after."""
    per_family = sample.groupBy("family").agg(F.count("*").alias("n"))
    family_numbers = per_family.agg(
        F.count("*").alias("n_families"), F.avg("n").alias("mean_genomes_per_family"), F.min("n").alias("family_min"), F.max("n").alias("family_max")
    )
    size = sample.agg(
        F.count("*").alias("n_genomes"), F.min("gc_content").alias("gc_min"), F.max("gc_content").alias("gc_max"), F.avg("gc_content").alias("gc_mean")
    )
    medians = [
        exact_quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, {name: 0.5}).drop("_all")
        for rows, value, name in ((per_family.withColumn("n", F.col("n").cast("double")), "n", "family_median"), (sample, "gc_content", "gc_median"))
    ]
    whole = population.agg(F.count("*").alias("n_population"))
    # Tables of one row each, read as scalars of the first.
    named = {c: part.select(c).scalar() for part in (family_numbers, *medians, whole) for c in part.columns}
    return size.withColumns(named)


def domain_shares(sample: DataFrame, population: DataFrame) -> DataFrame:
    """Genomes, families and shares per domain, in the population and in the sample."""

    def counted(df: DataFrame, suffix: str) -> DataFrame:
        families = df.groupBy("domain", "family").agg(F.count("*").alias("n"))
        per_domain = families.groupBy("domain").agg(F.sum("n").alias(f"n_{suffix}"), F.count("*").alias(f"families_{suffix}"))
        return per_domain.withColumn(f"share_{suffix}", F.col(f"n_{suffix}") / F.sum(f"n_{suffix}").over(Window.partitionBy()))

    return counted(population, "before").join(counted(sample, "after"), "domain", "left")


def partition_report(genomes: DataFrame) -> DataFrame:
    """Per partition, and per partition and domain: genomes, families, GC range, mean and median."""
    report = genomes.groupingSets([[F.col("partition")], [F.col("partition"), F.col("domain")]], "partition", "domain").agg(
        F.grouping_id().cast("int").alias("grouping_id"),
        F.count("*").alias("n_genomes"),
        F.count_distinct("family").alias("n_families"),
        F.min("gc_content").alias("gc_min"),
        F.max("gc_content").alias("gc_max"),
        F.avg("gc_content").alias("gc_mean"),
    )
    keys = ["partition", "domain", "grouping_id"]
    levels = F.array(
        F.struct(F.col("partition"), F.col("domain"), F.lit(0).alias("grouping_id")),
        F.struct(F.col("partition"), F.lit(None).cast("string").alias("domain"), F.lit(1).alias("grouping_id")),
    )
    spread = genomes.select("gc_content", F.explode(levels).alias("level")).select("gc_content", "level.*")
    medians = same_keys(exact_quantiles(spread, keys, "gc_content", {"gc_median": 0.5}), keys).drop(*keys)
    return same_keys(report, keys).join(medians, "_same", "left").drop("_same")


def read_counts_per_genome(reads: DataFrame, genomes: DataFrame) -> DataFrame:
    """Reads per data set and accession with species and partition."""
    counts = reads.groupBy("dataset", "accession").agg(F.count("*").alias("n_reads"))
    return counts.join(genomes.select("accession", "species", "partition"), "accession", "left")


def keep_rate(checked: DataFrame) -> DataFrame:
    """Per accession: kept and rejected reads and the kept percentage; ``checked`` has accession, kept."""
    return checked.groupBy("accession").agg(
        F.count_if("kept").alias("n_correct"),
        F.count_if(~F.col("kept")).alias("n_wrong"),
        F.round(F.count_if("kept") / F.count("*") * 100, 2).alias("percent_correct"),
    )
