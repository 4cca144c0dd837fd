"""Helpers of the operators: reading tables, words, lineage cuts and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
GAPS = r"[\x20\x09-\x0D]+"
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Where a public tokenizer and its vocabulary as ranks lie; every worker has their package."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input clash with nothing an operator adds."""
    return df.select(*names)


def words(text: Column) -> Column:
    """Words of a text in order; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def parts_of(spark: SparkSession, share: int = 1) -> int:
    """Number of shuffle partitions, or of a share of them for tables that are far smaller than the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def cut(df: DataFrame) -> DataFrame:
    """Make the rows now and keep them in the folder that ``spark.checkpoint.dir`` names.

    What follows reads those files and does not run the plan again, also after a lost executor.  Only a local session
    without that setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="readframe-llm-")
        context.setCheckpointDir(folder)
    kept = df.checkpoint(eager=True)
    # Kept rows would carry on the optimizer's guess of their size, which joins multiply in each round of a loop, until
    # working out the guess takes longer than the job.  So they start without any.
    session = df.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(rows, session)


def join_back(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Add to each row what ``totals`` has for its key.

    The totals are dealt out anew, by the key as text: with a plain shuffle on both sides adaptive execution can split the
    rows of a hot key, which it cannot where one side comes straight from an aggregate.
    """
    name = F.concat(F.lit("k"), F.col(key).cast("string"))
    return rows.withColumn("_name", name).join(totals.withColumn("_name", name).drop(key), "_name").drop("_name")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's connected component, from edges (a, b): rows (node, component).

    Alternates two steps until no edge changes.  Each edge first hangs its larger end on the smallest neighbour of the
    smaller one, then its smaller end on the smallest neighbour of the larger one, so the depth of every tree about
    halves and no node ever gathers its neighbours in one task: only their minimum is taken, which sums up per task.
    Only the number and a checksum of the edges come to the driver.  Self loops, repeated edges and nulls are ignored.
    """
    link = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    few = parts_of(edges.sparkSession, 4)  # edges are small: few files for each round
    now = cut(edges.where("a != b").select(*link).distinct().coalesce(few))
    state = _state(now)
    while state[0]:
        large = _hang(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), smaller=False)
        now = cut(_hang(large, smaller=True).coalesce(few))
        before, state = state, _state(now)
        if before == state:
            break
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.union(found.select("component", "component").distinct())


def _hang(pairs: DataFrame, smaller: bool) -> DataFrame:
    joined = join_back(pairs, pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")
    if smaller:
        moved = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        moved = moved.select("e.*")
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(pairs: DataFrame) -> tuple[int, int | None]:
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
