"""A Merkle manifest of documents: leaves get their places from bitmap ranks, and keyed slot arrays reduce the levels."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readframe.llm.ranks import ranked
from readframe.llm.shared import cut

FAN = 8
#: Levels that one slot array reduces, and its slots.
LEVELS = 3
SLOTS = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Hash of a document row; ``text`` stands in for its text."""
    return F.sha2(F.concat(*[_field(text if n == "text" and text is not None else F.col(n)) for n in FIELDS]), 256)


def fold(node: Column, lefts: Column, rights: Column) -> Column:
    """Root that a leaf and its siblings give, level by level."""
    levels = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(levels, node, lambda h, level: F.sha2(F.concat(level["l"], h, level["r"]), 256))


def _runs(slots: list[str]) -> list[str]:
    return [_hash("".join(slots[k : k + FAN])) for k in range(0, len(slots), FAN)]


def _height(n: int) -> int:
    """Levels that the slot array of a group with ``n`` nodes reduces."""
    return LEVELS if n > SLOTS else next(k for k in range(LEVELS + 1) if FAN**k >= n)


def _slots(block: pa.Table) -> list[str]:
    """Nodes of a block, each in the slot that its rank names."""
    slots = [""] * len(block)
    for rank, node in zip(block["rank"].to_pylist(), block["node"].to_pylist(), strict=True):
        slots[rank % SLOTS] = node
    return slots


def _up(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, total, rank, node) to those 512 times fewer; a group of one node keeps it."""

    def reduce(block: pa.Table) -> pa.Table:
        n = block["total"][0].as_py()
        slots = _slots(block)
        for _ in range(_height(n)):
            slots = _runs(slots)
        return pa.table({"grp": block["grp"].slice(0, 1), "total": [-(-n // SLOTS)], "rank": block["block"].slice(0, 1), "node": slots})

    placed = nodes.select("grp", "total", "rank", "node", F.expr(f"rank div {SLOTS}").alias("block"))
    return placed.groupBy("grp", "block").applyInArrow(reduce, "grp string, total long, rank long, node string")


def _down(nodes: DataFrame, above: DataFrame, names: list[str]) -> DataFrame:
    """Add to each node what ``above`` has for its block: the siblings on the way to the root, its own first, and ``names``."""

    def spread(block: pa.Table, known: pa.Table) -> pa.Table:
        # A block and what is above it always come together, as each block has one node there.
        height, slots = _height(block["total"][0].as_py()), _slots(block)
        lefts, rights = [[] for _ in slots], [[] for _ in slots]
        for level in range(height):
            runs = [slots[k : k + FAN] for k in range(0, len(slots), FAN)]
            for k in range(len(lefts)):
                run, at = divmod(k // FAN**level, FAN)
                lefts[k].append("".join(runs[run][:at]))
                rights[k].append("".join(runs[run][at + 1 :]))
            slots = _runs(slots)
        out = block.drop_columns("block")
        places = [rank % SLOTS for rank in out["rank"].to_pylist()]
        for side, own in (("lefts", lefts), ("rights", rights)):
            upper = known[side][0].as_py()
            out = out.append_column(side, pa.array([own[k] + upper for k in places], pa.list_(pa.string())))
        for name in names:
            out = out.append_column(name, pa.array([known[name][0].as_py()] * len(out), pa.string()))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    schema = kinds + ", lefts array<string>, rights array<string>" + "".join(f", {n} string" for n in names)
    placed = nodes.withColumn("block", F.expr(f"rank div {SLOTS}"))
    keyed = above.select("grp", F.col("rank").alias("block"), "lefts", "rights", *names)
    return placed.groupBy("grp", "block").cogroup(keyed.groupBy("grp", "block")).applyInArrow(spread, schema)


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Levels of slot arrays, from the given nodes to one node for each group."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels = [nodes, cut(_up(nodes))]
    while (most := -(-most // SLOTS)) > 1:
        levels.append(cut(_up(levels[-1])))
    return levels


def _paths(levels: list[DataFrame], top: DataFrame, names: list[str]) -> DataFrame:
    for level in reversed(levels[:-1]):
        top = _down(level, top, names)
    return top


def _in_order(rows: DataFrame, order: str) -> DataFrame:
    """Add rank and total by ascending ``order``, nulls first: ranges are counted apart, then put one after another."""
    ranged = cut(rows.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # as many rows as there are partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())
    placed = ranged.withColumn("_row", F.row_number().over(inside) - 1).join(starts, "_range")
    return placed.withColumn("rank", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")


def manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """Every document's leaf and its proof: (doc_id, leaf, subroot, root, lefts, rights, *extra).

    ``lefts`` and ``rights`` hold, level by level from the leaf through its language's subtree to the root, the digests beside
    the node, joined; :func:`fold` makes the root from them.  ``extra`` are further columns over the document's own.

    Null in a column: that field is ``-``; a null lang is a group of its own and comes first.  In a group, documents ascend by
    doc_id, nulls first, rows of one doc_id by their leaf; repeated rows are leaves of their own.  Empty text: ``0:``.
    Further columns are ignored.  No rows: no rows.

    A group's leaves are reduced by blocks of 512, so a hot language is as many tasks as it needs; rows carry hashes only.
    """
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("-"))
    rows = docs.select("doc_id", lang.alias("grp"), leaf().alias("node"), *[c.alias(n) for n, c in extra.items()])
    leaves = cut(ranked(rows, "grp", "doc_id", "node"))
    levels = _tree(leaves)
    named = levels[-1].select(F.col("grp").alias("name"), F.lit("").alias("grp"), "node", F.when(F.col("grp") != "-", F.expr("substr(grp, 2)")).alias("lang"))
    subroots = cut(_in_order(named, "lang").select("name", "grp", "total", "rank", "node"))
    over = _tree(subroots)
    none = F.array().cast("array<string>")
    root = over[-1].select("grp", "rank", none.alias("lefts"), none.alias("rights"), F.col("node").alias("root"))
    tops = cut(_paths(over, root, ["root"]))
    top = tops.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    found = _paths(levels, top, ["subroot", "root"])
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "lefts", "rights", *extra)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest with the root that each document's proof gives once some texts were changed.

    Changed are texts whose decimal doc_id has a crc32 that 3 divides: their A-Z become a-z.  Rows (doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified).  Documents without id or text stay as they are; otherwise as :func:`manifest`.
    """
    changed = F.translate("text", UPPER, LOWER)
    changes = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    found = manifest(docs, tampered=F.when(changes, leaf(changed)))
    proof = F.array_join(F.zip_with("lefts", "rights", lambda left, right: F.concat(left, right)), "")
    folded = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
