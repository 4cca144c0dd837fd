"""Session settings and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "readframe", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan to all cores if they come in fewer pieces than that, or most of them in a few.

    For inputs that cannot be split, such as a gzip file or a Parquet file of one row group, ahead of work that is heavy
    per row.  Where there are pieces enough their rows are counted, which reads no column: a file is cut by its bytes,
    but only the piece with the middle of a row group gets its rows.  A large even input is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        pieces = scan.groupBy(F.spark_partition_id().alias("piece")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (pieces["most"] or 0) * cores <= 2 * (pieces["all"] or 0):
            return scan
    return scan.repartition(2 * cores)


def task_number(df: DataFrame) -> int:
    """Partitions for a shuffle whose rows cost far more than their bytes tell, which adaptive execution would merge."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, made now and kept in the folder that ``spark.checkpoint.dir`` names, for jobs that iterate.

    A local session without that setting gets a folder of its own; on a cluster the folder must be shared.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="readframe-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The rows of a table with one short row per group, made now and kept, to be joined to a large one.

    With at most ``rows`` rows, which are counted, it is sent to all tasks, so that the large side stays where it is; a
    shuffle by few groups would put its rows into as few tasks.  A larger table is left to Spark's choice.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
