"""Lineages and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readframe.functions.cds import newick_name
from readframe.operators.scan import exact_quantiles, same_keys
from readframe.session import checkpointed

# The eight ranks of a genome row, and the ids of the two prokaryote domains.
RANKS = ("strain", "species", "genus", "family", "order", "class", "phylum", "domain")
TOP_TAXA = ("2", "2157")


def lineages(taxa: DataFrame, nodes: DataFrame, names: DataFrame, top: tuple[str, ...] = TOP_TAXA) -> DataFrame:
    """(accession, depth, tax_id, rank, name) from each accession's taxon up to a top taxon, both included.

    ``taxa`` has accession, tax_id.  The walk runs once per distinct taxon.  Paths double in length with each join, until
    none can grow; every round reads the last one twice, so its lineage is cut.  Finished paths join on a key of their
    own: a shared key for all of them would send most of the tree to one task.  Taxa that do not reach a top taxon have
    no lineage; taxa that are their own ancestors raise an error.
    """
    parents = nodes.groupBy("tax_id").agg(F.first("parent_id").alias("parent_id"))
    at_top = F.col("tax_id").isin(*top) | (F.col("tax_id") == F.col("parent_id"))
    # A path lists the ancestors above a taxon; the steps above a top taxon are empty.
    nothing = F.array().cast("array<string>")
    paths = parents.select("tax_id", F.when(at_top, nothing).otherwise(F.array("parent_id")).alias("path"), (~at_top).alias("grows"))
    while True:
        paths = checkpointed(paths)
        state = paths.agg(F.count("*").alias("taxa"), F.max(F.when(F.col("grows"), F.size("path"))).alias("longest")).first()
        if state["longest"] is None:
            break
        if state["longest"] > state["taxa"]:
            raise ValueError("the taxonomy has a cycle")
        last = F.element_at("path", F.when(F.col("grows"), -1))
        key = F.coalesce(last, F.concat(F.lit("done:"), F.col("tax_id")))
        above = paths.select(F.col("tax_id").alias("_key"), F.col("path").alias("_above"), F.col("grows").alias("_grows"))
        paths = (
            paths.withColumn("_key", key)
            .join(above, "_key", "left")
            .select("tax_id", F.concat("path", F.coalesce("_above", nothing)).alias("path"), F.coalesce("_grows", F.lit(False)).alias("grows"))
        )
    wanted = taxa.select("tax_id").distinct().join(paths, "tax_id")
    full = wanted.withColumn("path", F.concat(F.array("tax_id"), F.col("path")))
    reached = full.filter(F.element_at("path", -1).isin(*top))
    steps = reached.select("tax_id", F.posexplode("path").alias("depth", "step_id"))
    ranked = steps.join(nodes.select(F.col("tax_id").alias("step_id"), "rank"), "step_id").join(
        names.select(F.col("tax_id").alias("step_id"), "name"), "step_id"
    )
    return taxa.join(ranked, "tax_id").select("accession", "depth", F.col("step_id").alias("tax_id"), "rank", "name")


def rank_columns(lineage: DataFrame) -> DataFrame:
    """One row per accession with a column per rank; of several taxa with one rank the highest counts."""
    picked = [F.max_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("depth"))).alias(r) for r in RANKS]
    return lineage.groupBy("accession").agg(*picked)


def newick_tokens(genomes: DataFrame, ranks: list[str], root: str = "root") -> DataFrame:
    """The taxonomy tree in Newick form as ordered rows (sort_key, token); a missing rank is ``Unknown_{rank}``.

    Concatenated in sort_key order the tokens are the tree.  A tree of any size is written by a distributed sort and
    never has to fit into one row.  Children follow in name order.
    """
    filled = [
        F.coalesce(F.when(F.col(r) != "", F.col(r)), F.lit(f"Unknown_{r}")).alias(r) for r in ranks
    ]
    leaves = genomes.select(*filled, F.col("accession").alias("_leaf")).distinct()
    path = F.array(*ranks, "_leaf")
    depth = len(ranks) + 1
    # Every node once, as its path below the root; the root is the empty path.
    prefixes = F.array(*[F.slice(path, F.lit(1), F.lit(n)) for n in range(1, depth + 1)])
    nodes = leaves.select(F.explode(prefixes).alias("path")).distinct()
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    nodes = nodes.select("path", parent.alias("parent"), F.element_at("path", -1).alias("name"))
    first_child = nodes.groupBy("parent").agg(F.min("name").alias("first_name"))
    placed = nodes.join(first_child, "parent")
    comma = F.when(F.col("name") == F.col("first_name"), "").otherwise(",")
    # Names sort below U+FFFF, so a node's closing token follows its whole subtree.
    opening, closing = F.lit("\u0001"), F.lit("\uffff")
    is_leaf = F.size("path") == depth

    def key(*parts):
        return F.array_join(F.concat(*parts), "\u0000")

    tokens = F.when(
        is_leaf, F.array(F.struct(key(F.col("path")).alias("sort_key"), F.concat(comma, newick_name(F.col("name"))).alias("token")))
    ).otherwise(
        F.array(
            F.struct(key(F.col("path"), F.array(opening)).alias("sort_key"), F.concat(comma, F.lit("(")).alias("token")),
            F.struct(key(F.col("path"), F.array(closing)).alias("sort_key"), F.concat(F.lit(")"), newick_name(F.col("name"))).alias("token")),
        )
    )
    body = placed.select(F.inline(tokens))
    ends = genomes.sparkSession.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit("").alias("sort_key"), F.lit("(").alias("token")),
                F.struct(closing.alias("sort_key"), F.lit(f"){root};").alias("token")),
            )
        )
    )
    return body.unionByName(ends)


def family_table(genomes: DataFrame, family: str = "family") -> DataFrame:
    """Genomes per family with median, min and max of size, genes, coding share and GC."""
    columns = ("genome_length_kb", "protein_coding_genes", "coding_percentage", "gc_content")
    aggs = [F.count("*").alias("n_genomes")]
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = same_keys(genomes.groupBy(family).agg(*aggs), [family])
    for c in columns:
        medians = exact_quantiles(genomes.select(family, F.col(c).cast("double").alias(c)), [family], c, {f"{c}_median": 0.5})
        out = out.join(same_keys(medians, [family]).drop(family), "_same", "left")
    return out.drop("_same")


def reference_organisms(genomes: DataFrame, accessions: DataFrame) -> DataFrame:
    """Listed genomes with the name of their strain, else of their species."""
    listed = genomes.join(accessions.select("accession").distinct(), "accession", "left_semi")
    return listed.withColumn("organism", F.coalesce("strain", "species"))


def with_family(genomes: DataFrame) -> DataFrame:
    return genomes.filter(F.col("family").isNotNull())


def annotation_table(genomes: DataFrame) -> DataFrame:
    """Leaf colours for a tree viewer: taxa, partition."""
    return genomes.select(F.col("accession").alias("taxa"), "partition")


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.select("accession").subtract(done.select("accession"))


def union_lists(*lists: DataFrame) -> DataFrame:
    """Distinct accessions of several lists."""
    return reduce(lambda a, b: a.unionByName(b), [x.select("accession") for x in lists]).distinct()
