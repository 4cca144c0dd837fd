"""Statistics over metric tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readframe.functions.draws import DRAW_BITS, heads
from readframe.functions.metrics import f1, ratio
from readframe.operators.scan import average_ranks, exact_quantiles, same_keys
from readframe.session import checkpointed, task_number

# The settings of the paired test.
PERMUTATIONS = 1000
SEED = 42
MIN_SHARED_GENOMES = 5
#: Coins that one hash gives.
COINS = 2 * DRAW_BITS
COUNTS = ["tp", "fp", "fn"]


def spearman(scores: DataFrame, keys: list[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Rank correlation of two columns per key: rho, n and its t statistic; keys with fewer rows are left out."""
    # Kept, as both columns are ranked by several passes and what leads to the scores is long.
    data = checkpointed(scores.select(*keys, x, y).dropna(subset=[x, y]))
    ranked = average_ranks(average_ranks(data, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    spread = F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho"))
    return out.filter(F.col("n") >= min_rows).withColumn("t_statistic", F.col("rho") * F.sqrt(spread))


def least_squares(scores: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y over x per key."""
    return scores.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_numbers(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population spread, quartiles and 1.5-IQR whisker ends."""
    # Kept, as mean, quartiles and whiskers are passes of their own and what leads to the scores is long.
    values = checkpointed(scores.select(*keys, F.col(value).cast("double").alias("_v")))
    stats = values.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("std"),
        F.min("_v").alias("minimum"),
        F.max("_v").alias("maximum"),
    )
    quartiles = exact_quantiles(values, keys, "_v", QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = same_keys(quartiles.withColumns({"_lo": F.col("q1") - reach, "_hi": F.col("q3") + reach}), keys)
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    ends = (
        same_keys(values, keys)
        .join(fences.drop(*keys), "_same")
        .groupBy("_same")
        .agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"))
    )
    out = same_keys(stats, keys).join(fences.drop(*keys, "_lo", "_hi"), "_same", "left").join(ends, "_same", "left")
    return out.drop("_same")


def describe(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Count, mean, sample spread, min, quartiles and max of several columns, one row per key and column."""
    stacked = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("statistic"), F.col(v).cast("double").alias("v")) for v in values])).alias("s"),
    ).select(*keys, "s.statistic", "s.v")
    rows = [*keys, "statistic"]
    out = stacked.groupBy(*rows).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("minimum"), F.max("v").alias("maximum")
    )
    quartiles = same_keys(exact_quantiles(stacked, rows, "v", QUARTILES), rows).drop(*rows)
    return same_keys(out, rows).join(quartiles, "_same", "left").drop("_same")


def sequence_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of perfect and of >90% right sequences, mean accuracy and multi-class MCC, per seq_desc and in total.

    ``pairs`` has seq_desc, true_labels, predicted_labels.  The total row has seq_desc NULL and is_total true.
    """
    same = F.zip_with("true_labels", "predicted_labels", lambda a, b: (a == b).cast("int"))
    hits = F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    accuracy = ratio(hits, F.size("true_labels"))
    rows = pairs.withColumn("_accuracy", accuracy)
    by_type = rows.groupingSets([[F.col("seq_desc")], []], "seq_desc").agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count("*").alias("n_sequences"),
        F.avg((F.col("_accuracy") == 1.0).cast("double")).alias("fraction_perfect"),
        F.avg((F.col("_accuracy") > 0.9).cast("double")).alias("fraction_high"),
        F.avg("_accuracy").alias("accuracy"),
    )
    cells = (
        pairs.select("seq_desc", F.explode(F.arrays_zip(F.col("true_labels").alias("t"), F.col("predicted_labels").alias("p"))).alias("c"))
        .select("seq_desc", F.col("c.t").alias("t"), F.col("c.p").alias("p"))
        .groupBy("seq_desc", "t", "p")
        .agg(F.count("*").alias("n"))
    )
    # From here on the tables hold at most types x classes^2 rows.
    both = cells.groupingSets([[F.col("seq_desc"), F.col("t"), F.col("p")], [F.col("t"), F.col("p")]], "seq_desc", "t", "p").agg(
        (F.grouping_id() > 0).alias("is_total"), F.sum("n").cast("double").alias("n")
    )
    keys = ["is_total", "seq_desc"]

    def squares(side: str) -> DataFrame:
        per_class = both.groupBy(*keys, side).agg(F.sum("n").alias("s"))
        return per_class.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias(f"_{side}{side}"))

    true_sums = both.groupBy(*keys, F.col("t").alias("k")).agg(F.sum("n").alias("tk"))
    pred_sums = both.groupBy(*keys, F.col("p").alias("k")).agg(F.sum("n").alias("pk"))
    same_key = lambda a, b: (a["is_total"] == b["is_total"]) & a["seq_desc"].eqNullSafe(b["seq_desc"])
    a, b = true_sums.alias("a"), pred_sums.alias("b")
    cross = (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.is_total") == F.col("b.is_total")) & F.col("a.seq_desc").eqNullSafe(F.col("b.seq_desc")))
        .groupBy(F.col("a.is_total").alias("is_total"), F.col("a.seq_desc").alias("seq_desc"))
        .agg(F.sum(F.col("tk") * F.col("pk")).alias("_tp"))
    )
    right = both.groupBy(*keys).agg(F.sum("n").alias("_s"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("_c"))
    joined = right
    for other in (squares("t"), squares("p"), cross):
        joined = joined.join(other, same_key(joined, other), "left").select(joined["*"], *[other[c] for c in other.columns if c not in keys])
    tp = F.coalesce("_tp", F.lit(0.0))
    s = F.col("_s")
    mcc = ratio(F.col("_c") * s - tp, F.sqrt(s * s - F.col("_tt")) * F.sqrt(s * s - F.col("_pp")))
    joined = joined.select(*keys, mcc.alias("mcc"))
    return by_type.join(joined, same_key(by_type, joined)).select(by_type["*"], joined["mcc"])


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Mean loss per category over batches (category, loss, n), weighted by n."""
    return batches.groupBy("category").agg(ratio(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("mean_loss"))


def holm(tests: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """Add p_holm: Holm's step-down correction within each family of tests, which is as small as the model pairs."""
    by_p = Window.partitionBy(*family).orderBy("p_value", *order)
    whole = Window.partitionBy(*family)
    factor = F.count("*").over(whole) - F.row_number().over(by_p) + 1
    scaled = tests.withColumn("_scaled", F.col("p_value") * factor)
    running = F.max("_scaled").over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("p_holm", F.least(running, F.lit(1.0))).drop("_scaled")


def _pair_counts(read_counts: DataFrame, models: list[str], min_genomes: int) -> DataFrame:
    """(testset, model_a, model_b, counts of a and b, n): how many reads have these counts under the two models."""
    # Plain numbers are put side by side in a hash table; structs would have the reads sorted.
    per_model = [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"_{c}{i}") for i, m in enumerate(models) for c in COUNTS]
    per_read = read_counts.groupBy("testset", "accession", "read_name").agg(*per_model)
    counts = [F.struct(*[F.col(f"_{c}{i}").alias(c) for c in COUNTS]) for i in range(len(models))]
    per_read = per_read.withColumns({f"_m{i}": F.when(F.col(f"_tp{i}").isNotNull(), x) for i, x in enumerate(counts)})
    # Reads of a genome with equal counts go on as one row, made once: which genomes count follows from the same rows.
    alike = checkpointed(per_read.groupBy("testset", "accession", *[f"_m{i}" for i in range(len(models))]).agg(F.count("*").alias("n")))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    pairs = F.array(
        *[
            F.struct(
                F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"),
                F.coalesce(f"_m{i}", zero).alias("a"), F.coalesce(f"_m{j}", zero).alias("b"),
            )
            for i, j in combinations(range(len(models)), 2)
        ]
    )
    vectors = (
        alike.select("testset", "accession", "n", F.explode(pairs).alias("x"))
        .select("testset", "accession", "n", "x.*")
        .groupBy("testset", "accession", "model_a", "model_b", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    scored = alike.groupBy("testset", "accession").agg(*[F.max(F.col(f"_m{i}").isNotNull()).alias(f"_has{i}") for i in range(len(models))])
    both = [
        F.when(F.col(f"_has{i}") & F.col(f"_has{j}"), F.struct(F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b")))
        for i, j in combinations(range(len(models)), 2)
    ]
    shared = scored.select("testset", "accession", F.explode(F.array_compact(F.array(*both))).alias("x")).select("testset", "accession", "x.*")
    enough = shared.groupBy("testset", "model_a", "model_b").agg(F.count("*").alias("n_genomes")).filter(F.col("n_genomes") >= min_genomes)
    kept = shared.join(enough, ["testset", "model_a", "model_b"], "left_semi")
    return (
        vectors.join(kept, ["testset", "accession", "model_a", "model_b"], "left_semi")
        .groupBy("testset", "model_a", "model_b", "a", "b")
        .agg(F.sum("n").alias("n"))
    )


PAIR = ["testset", "model_a", "model_b"]


def observed_differences(read_counts: DataFrame, models: list[str], min_genomes: int = MIN_SHARED_GENOMES) -> DataFrame:
    """F1 of both models and their difference per model pair, over the genomes that both have scored."""
    return _observed(_pair_counts(read_counts, models, min_genomes))


def _observed(vectors: DataFrame) -> DataFrame:
    sums = vectors.groupBy(*PAIR).agg(
        *[F.sum(F.col(f"{side}.{c}") * F.col("n")).alias(f"{side}_{c}") for side in "ab" for c in ("tp", "fp", "fn")]
    )
    f1_of = {side: f1(*[F.col(f"{side}_{c}") for c in ("tp", "fp", "fn")]) for side in "ab"}
    return sums.withColumns({"f1_a": f1_of["a"], "f1_b": f1_of["b"]}).withColumn("difference", F.col("f1_a") - F.col("f1_b"))


def permutation_test(
    read_counts: DataFrame,
    models: list[str],
    n_permutations: int = PERMUTATIONS,
    seed: int = SEED,
    min_genomes: int = MIN_SHARED_GENOMES,
) -> DataFrame:
    """Two-sided p value of the F1 difference per model pair when reads swap models at random.

    ``read_counts`` has one row (model, testset, accession, read_name, tp, fp, fn) per read with any count.  Reads of
    equal count differences are exchangeable, so it only matters how many of them swap: the heads among as many coins,
    120 coins from one hash of the pair, the difference, the permutation and a counter.  Coins of a frequent difference
    are dealt over tasks.
    """
    vectors = checkpointed(_pair_counts(read_counts, models, min_genomes))
    deltas = (
        vectors.select(*PAIR, *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in COUNTS], "n")
        .filter("tp != 0 or fp != 0 or fn != 0")
        .groupBy(*PAIR, *COUNTS)
        .agg(F.sum("n").alias("n"))
    )
    # A row of few bytes stands for a thousand hashes, so their number of tasks is named: by bytes they would be one.
    coins = deltas.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COINS})"))).repartition(task_number(deltas), "block", *PAIR, *COUNTS)
    thrown = coins.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    in_block = F.least(F.lit(COINS), F.col("n") - F.col("block") * COINS)
    swapped = heads(in_block, F.lit(seed), *[F.col(c) for c in (*PAIR, *COUNTS, "block", "permutation")])
    moved = thrown.withColumn("_swapped", swapped)
    per_permutation = moved.groupBy(*PAIR, "permutation").agg(*[F.sum(F.col(c) * F.col("_swapped")).alias(c) for c in COUNTS])
    observed = _observed(vectors)
    both = per_permutation.join(observed, PAIR)
    permuted = f1(*[F.col(f"a_{c}") + F.col(c) for c in ("tp", "fp", "fn")]) - f1(*[F.col(f"b_{c}") - F.col(c) for c in ("tp", "fp", "fn")])
    extreme = (F.abs(permuted) >= F.abs("difference")).cast("double")
    p = both.groupBy(*PAIR).agg(F.avg(extreme).alias("_p"))
    # A pair without any differing read has no permutation rows: every permutation equals the observation.
    p_value = F.greatest(F.coalesce("_p", F.lit(1.0)), F.lit(1.0 / n_permutations))
    return observed.join(p, PAIR, "left").select(*PAIR, "f1_a", "f1_b", "difference", p_value.alias("p_value"))


def pair_report(tests: DataFrame, testsets: list[str], n_permutations: int = PERMUTATIONS) -> DataFrame:
    """Corrected p values as text, model pair by testset; ``<1/N`` where the test hit its floor."""
    floor = 1.0 / n_permutations
    text = F.when(F.col("p_holm") <= floor, F.lit(f"<{floor:g}")).otherwise(F.format_string("%.3f", "p_holm"))
    return tests.withColumn("_text", text).groupBy("model_a", "model_b").pivot("testset", testsets).agg(F.first("_text"))
