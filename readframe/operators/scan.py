"""Ordered scans that hold when one key owns a third of the rows.

A plain window over a hot key sorts that whole key in one task.  Here the order axis is cut into buckets: a window
runs inside each (key, bucket), and the totals of earlier buckets, one row per bucket, are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(local, carried)  # greatest skips NULL
    return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def running_before(
    df: DataFrame, keys: list[str], order: str, bucket: Column, columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add running ``max`` or ``sum`` over the rows strictly before each row, per key.

    ``columns`` maps an output name to (kind, input column).  Rows are unique per (keys, order); callers aggregate
    first, which also bounds a bucket by the number of distinct order values in it.  ``bucket`` must not decrease as
    ``order`` grows.
    """
    pick = {"max": F.max, "sum": F.sum}
    bucketed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumns({f"_local_{out}": pick[kind](src).over(inside) for out, (kind, src) in columns.items()})
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[pick[kind](src).alias(f"_total_{out}") for out, (kind, src) in columns.items()])
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_bucket", *[pick[kind](f"_total_{out}").over(across).alias(f"_carry_{out}") for out, (kind, _) in columns.items()]
    )
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        *[_combine(kind, F.col(f"_local_{out}"), F.col(f"_carry_{out}")).alias(out) for out, (kind, _) in columns.items()],
    )


def smallest_per_stratum(
    df: DataFrame, strata: list[str], quota: str, draw: Column, tie: str, coarse_bits: int = 16
) -> DataFrame:
    """Keep exactly ``quota`` rows per stratum, those with the smallest draw; ``tie`` orders equal draws.

    ``draw`` is a non-negative long.  Whole ranges of draws are taken by their counts; rows are only ranked inside the
    one range where the quota ends, about one row in 2^coarse_bits of a stratum.  NULL strata are strata too.
    """
    drawn = df.withColumn("_draw", draw).withColumn("_range", F.shiftrightunsigned("_draw", 63 - coarse_bits))
    # NULL-safe keys: a struct is never NULL and compares NULL fields as equal.
    drawn = drawn.withColumn("_stratum", F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}))
    counts = drawn.groupBy("_stratum", "_range").agg(F.count("*").alias("_n"), F.max(quota).alias("_quota"))
    before = Window.partitionBy("_stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.filter("_before < _quota").select(
        "_stratum",
        "_range",
        (F.col("_quota") - F.col("_before")).alias("_room"),
        (F.col("_before") + F.col("_n") > F.col("_quota")).alias("_is_edge"),
    )
    reached = drawn.join(ranges, ["_stratum", "_range"])
    whole = reached.filter(~F.col("_is_edge")).select(*df.columns)
    in_range = Window.partitionBy("_stratum", "_range").orderBy("_draw", tie)
    edge = reached.filter("_is_edge").withColumn("_rank", F.row_number().over(in_range)).filter("_rank <= _room")
    return whole.unionByName(edge.select(*df.columns))


def same_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_same``, one value per combination of keys that joins NULLs as well."""
    return df.withColumn("_same", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def _ordered_counts(df: DataFrame, keys: list[str], value: str, slices: int) -> DataFrame:
    """(_same, keys, value, _n, _before): each distinct value of a key, how often it occurs, and how many rows are smaller.

    The distinct values are scanned in slices between counted quantiles, so each slice has about as many of them.
    """
    counts = same_keys(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys)
    steps = [k / slices for k in range(1, slices)]
    edges = counts.groupBy("_same").agg(F.percentile_approx(F.col(value).cast("double"), steps, 20 * slices).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return running_before(counts.join(edges, "_same").withColumn("_slice", below).drop("_edges"), ["_same"], value, F.col("_slice"), {"_before": ("sum", "_n")})


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, slices: int = 64) -> DataFrame:
    """Rank of each row's value among its key's rows, ties sharing their mean rank; rows without a value have none."""
    present = df.filter(F.col(value).isNotNull())
    ranks = _ordered_counts(present, keys, value, slices).select("_same", F.col(value).alias("_value"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    joined = same_keys(df, keys).alias("d").join(ranks.alias("r"), (F.col("d._same") == F.col("r._same")) & (F.col(value) == F.col("_value")), "left")
    return joined.select("d.*", out).drop("_same")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], slices: int = 64) -> DataFrame:
    """(keys, one column per quantile), interpolated between neighbours; NULL values are left out.

    Ranks come from a scan in slices, so no task holds all values of a key.
    """
    ordered = _ordered_counts(df.filter(F.col(value).isNotNull()), keys, value, slices)
    totals = ordered.groupBy("_same").agg(F.sum("_n").alias("_total"))
    placed = ordered.join(totals, "_same")

    def at(place):
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col(value)))

    def quantile(q: float):
        place = (F.col("_total") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.groupBy("_same", *keys).agg(*[quantile(q).alias(name) for name, q in quantiles.items()]).drop("_same")


def number_rows(df: DataFrame, strata: list[str], draw: Column, tie: str, out: str, coarse_bits: int = 16) -> DataFrame:
    """Number the rows of each stratum 0, 1, 2 ... in the order of a non-negative long draw."""
    drawn = df.withColumn("_draw", draw).withColumn("_range", F.shiftrightunsigned("_draw", 63 - coarse_bits))
    counts = drawn.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_range", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*strata, "_range").orderBy("_draw", tie)
    numbered = drawn.withColumn("_row", F.row_number().over(inside)).join(offsets, [*strata, "_range"])
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_row") - 1).alias(out))
