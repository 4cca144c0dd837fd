"""Salting of keys that are measured to be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000


def salt_hot_keys(
    big: DataFrame, small: DataFrame, keys: list[str], row_id: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Add a ``_salt`` column to both sides of an equi-join on ``keys``.

    Keys with more than ``hot_rows`` rows on the big side are cut into that many parts and their small-side rows are
    repeated once per part; all other keys keep salt 0.  There are at most ``rows / hot_rows`` hot keys, so Spark's
    size-checked auto broadcast joins them without a shuffle of the big side.
    """
    hot = (
        big.groupBy(*keys)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    )
    salted_big = (
        big.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int")),
        )
        .drop("_parts")
    )
    salted_small = (
        small.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted_big, salted_small
