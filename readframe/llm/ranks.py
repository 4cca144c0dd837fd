"""Places of rows in their group without sorting the rows: compressed bitmaps of keys with counts before each word.

A group's keys set bits in words of 64; words without a bit are not kept.  Each task merges its own words first.  A
directory gives each word the number of rows before it, so a row's place is that number and the bits below its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readframe.llm.shared import cut

#: Entries of one directory block are a power of two.
BLOCK_BITS = 10
#: Word of rows without a key: below every word of a 64-bit key.
NO_KEY = -(2**57) - 1
#: Copies of one row that a task writes out at a time.
COPIES = 65_536


def running(entries: DataFrame, group: str, key: str, columns: list[str], xor: bool = False) -> DataFrame:
    """Add ``before_c``, the sum (or xor) of c over smaller keys of the group, and ``total_c`` for each of ``columns``.

    ``entries`` has one row per (group, key), neither null, and is read several times, so it should be cut.  Sums are taken
    inside blocks of 1024 neighbouring keys, then over the blocks, and so on: no task holds a whole group.
    """
    gather, joint = (F.bit_xor, Column.bitwiseXOR) if xor else (F.sum, Column.__add__)
    spans = entries.groupBy(group).agg(F.expr(f"min({key}) ^ max({key})").alias("x"))
    bits = spans.agg(F.max(F.expr("if(x < 0, 64, length(bin(x)))"))).first()[0] or 0
    levels = [entries.select(group, F.col(key).alias("_key"), *columns)]
    for _ in range(max(0, -(-bits // BLOCK_BITS) - 1)):
        up = F.shiftright("_key", BLOCK_BITS).alias("_key")
        levels.append(levels[-1].groupBy(group, up).agg(*[gather(c).alias(c) for c in columns]))
    zero = F.lit(0).cast("long")
    # What is left of a group at the top is at most one block, also where keys of both signs never meet by shifts.
    top = levels[-1].groupBy(group, zero.alias("_block"))
    known = top.agg(*[F.first(zero).alias(f"before_{c}") for c in columns], *[gather(c).alias(f"total_{c}") for c in columns])
    for level in reversed(levels):
        blocks = level.withColumn("_block", zero if level is levels[-1] else F.shiftright("_key", BLOCK_BITS))
        inside = Window.partitionBy(group, "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        local = blocks.select(group, "_key", "_block", *[F.coalesce(gather(c).over(inside), zero).alias(f"_{c}") for c in columns])
        joined = local.join(known, [group, "_block"])
        known = joined.select(
            group, F.col("_key").alias("_block"), *[joint(F.col(f"before_{c}"), F.col(f"_{c}")).alias(f"before_{c}") for c in columns], *[f"total_{c}" for c in columns]
        )
    return entries.join(known.withColumnRenamed("_block", key), [group, key])


def ranked(rows: DataFrame, group: str, key: str, digest: str) -> DataFrame:
    """Add ``rank``, from 0 in each group by ascending key, nulls first, and ``total``, the group's rows.

    ``group`` has no nulls, ``key`` is an integer, ``digest`` lowercase hex that tells rows of one key apart: rows with equal
    keys follow its order, and rows that agree in it as well are taken to be equal.  Rows come back in any order, repeated
    rows as often as they were given.  ``rows`` is read twice.
    """
    key_type = rows.schema[key].dataType.simpleString()
    bit = F.expr(f"coalesce(cast({key} & 63 as int), 0)")
    placed = rows.withColumns({"_word": F.coalesce(F.shiftright(F.col(key).cast("long"), 6), F.lit(NO_KEY)), "_bit": bit})
    words = placed.groupBy(group, "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"), F.count("*").alias("_n"))
    directory = cut(running(cut(words), group, "_word", ["_n"]))
    joined = placed.join(directory, [group, "_word"])
    alone = F.expr("_n = bit_count(_bits)")
    below = F.expr("before__n + bit_count(_bits & ~shiftleft(-1L, _bit))")
    single = joined.where(alone).select(*rows.columns, below.alias("rank"), F.col("total__n").alias("total"))
    if directory.where(~alone).isEmpty():
        return single
    return single.union(_ties(joined.where(~alone), rows.columns, group, digest).withColumn(key, F.col(key).cast(key_type)))


def _ties(joined: DataFrame, names: list[str], group: str, digest: str) -> DataFrame:
    """Rows of words where keys repeat, in the order of key and digest; equal rows are one row with a count until the end."""
    rest = [n for n in names if n not in (group, digest)]
    folded = joined.groupBy(F.concat_ws(":", group, "_word").alias("_place"), "_bit", group, digest).agg(
        *[F.first(n).alias(n) for n in rest], F.count("*").alias("_copies"), F.first("before__n").alias("_before"), F.first("total__n").alias("_total")
    )
    number = F.shiftleft(F.col("_bit").cast("long"), 52) + _number(F.col(digest))
    folded = cut(folded.withColumn("_order", number))
    sums = cut(folded.groupBy("_place", "_order").agg(F.sum("_copies").alias("_copies")))
    starts = running(sums, "_place", "_order", ["_copies"]).select("_place", "_order", "before__copies")
    inside = Window.partitionBy("_place", "_order").orderBy(digest).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("_same", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(starts, ["_place", "_order"])
    first = placed.withColumn("_rank", F.col("_before") + F.col("before__copies") + F.col("_same"))
    chunks = first.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPIES})"))).repartition("_rank", "_chunk")
    copies = chunks.withColumn("_copy", F.explode(F.expr(f"sequence(_chunk * {COPIES}, least(_copies, (_chunk + 1) * {COPIES}) - 1)")))
    return copies.select(*names, (F.col("_rank") + F.col("_copy")).alias("rank"), F.col("_total").alias("total"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
