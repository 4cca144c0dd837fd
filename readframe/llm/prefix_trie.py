"""Prefix trie of conversations: equal blocks of several turns are folded first, turns are told apart only where blocks differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.llm.ranks import ranked, running
from readframe.llm.shared import cut, join_back

#: Turns of a block.
BLOCK = 4
#: Conversation ids, as a power of two, whose decimal form makes one chunk.
CHUNK_BITS = 9
#: Fixed value: the textless node above all first turns.
ROOT = "0.0.0"


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns by place: (conv, pos from 0, total turns, digest, chars).

    Ordered by turn, null first, and by their digest where turns are equal.  Null role or text: empty.  Rows without conv_id
    belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return cut(ranked(rows, "conv", "turn", "digest").select("conv", F.col("rank").alias("pos"), "total", "digest", "chars"))


def rebuilt(turns: DataFrame, most: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (turns, conversations).

    The first h turns of each give way to those of the conversation whose id is the next lower multiple of ``family``, as many as
    that one has; h is the crc32 of the decimal id modulo ``most``.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    convs = turns.where("pos = 0").select("conv", "total", h.alias("h"), F.expr(f"conv - conv % {family}").alias("base"))
    bases = turns.where(f"pos = 0 and conv % {family} = 0").select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    n_head = F.least("h", F.coalesce("base_total", F.lit(0)))
    sized = convs.join(bases, "base", "left").withColumn("n_head", n_head)
    sized = cut(sized.select("conv", "base", "n_head", F.col("h"), (F.col("n_head") + F.greatest(F.lit(0), F.col("total") - F.col("h"))).alias("total")))
    heads = turns.where(f"conv % {family} = 0 and pos < {most}").select(F.col("conv").alias("base"), "pos", "digest", "chars")
    heads = heads.join(sized, "base").where("pos < n_head").select("conv", "pos", "total", "digest", "chars")
    tails = turns.drop("total").withColumn("own", h).where("pos >= own").join(sized, "conv")
    tails = tails.select("conv", (F.col("n_head") + F.col("pos") - F.col("own")).alias("pos"), "total", "digest", "chars")
    return heads.union(tails), sized.select("conv", "total")


def _name(depth: Column, first: Column, second: Column) -> Column:
    return F.concat_ws(".", depth.cast("string"), first.cast("string"), second.cast("string"))


def _marks(digest: Column) -> tuple[Column, Column]:
    """120 bits of a digest as two longs."""
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def _blocks(turns: DataFrame) -> DataFrame:
    """Blocks of each conversation with the mark of what stands before: (conv, k, total, turns, m1, m2, before_m1, before_m2).

    A mark hashes a block's place and turns; the xor of all earlier ones names the prefix.
    """
    block = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns")
    blocks = turns.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("k")).agg(F.first("total").alias("total"), block)
    first, second = _marks(_prefix_digest(F.size("turns")))
    return cut(running(cut(blocks.withColumns({"m1": first, "m2": second})), "conv", "k", ["m1", "m2"], xor=True))


def _prefix_digest(n: Column) -> Column:
    """Hash of a block's place and its first ``n`` turns."""
    return F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), F.array_join(F.transform(F.slice("turns", F.lit(1), n), lambda t: t["digest"]), "")), 256)


def _nodes(blocks: DataFrame, *keep: str) -> DataFrame:
    """Nodes that a block adds, one for each of its turns: (node, parent, depth, chars, *keep)."""

    def node(j: Column) -> Column:
        first, second = _marks(_prefix_digest(j))
        name = _name(F.col("k") * BLOCK + j, F.col("before_m1").bitwiseXOR(first), F.col("before_m2").bitwiseXOR(second))
        return F.struct(name.alias("node"), (F.col("k") * BLOCK + j).alias("depth"), F.element_at("turns", j)["chars"].alias("chars"))

    path = blocks.withColumn("path", F.transform(F.sequence(F.lit(1), F.size("turns")), node))
    rows = path.select("above", *keep, "path", F.posexplode("path").alias("at", "now"))
    parent = F.when(F.col("at") == 0, F.col("above")).otherwise(F.expr("path[at - 1].node"))
    return rows.select("now.node", parent.alias("parent"), "now.depth", "now.chars", *keep)


def _folded(blocks: DataFrame, *sums: Column) -> DataFrame:
    """Blocks that are equal, with all before them, as one row: (above, k, before_m1, before_m2, turns, *sums)."""
    keys = ["k", "before_m1", "before_m2", "m1", "m2", F.size("turns").alias("size")]
    folded = blocks.groupBy(*keys).agg(F.first("turns").alias("turns"), *sums)
    return folded.withColumn("above", _name(F.col("k") * BLOCK, F.col("before_m1"), F.col("before_m2")))


def _merged(blocks: DataFrame) -> DataFrame:
    """Nodes with members and smallest member.

    A block without siblings gives its nodes as they are; only nodes of sibling blocks are compared.
    """
    counted = cut(_folded(blocks, F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")))
    siblings = counted.groupBy("above").agg(F.count("*").alias("siblings"))
    nodes = _nodes(join_back(counted, siblings, "above"), "n_convs", "conv_id", "siblings")
    names = ["node", "parent", "depth", "chars", "n_convs", "conv_id"]
    diverging = nodes.where("siblings > 1").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    return nodes.where("siblings = 1").select(*names).union(diverging.select(*names))


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """Hash of the ids of conversations that end at a node: (node, ends_sha256).

    Ids are put together by ranges of 512, then the hash runs over a node's ranges in order, holding its state only.
    """
    last = blocks.where(f"k = (total - 1) div {BLOCK}").select("conv", _last(blocks).alias("node"))
    ends = last.union(convs.where("total = 0").select("conv", F.lit(ROOT)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("node", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _pairs(done)
        if now is not None:
            yield _pairs([(now, state.hexdigest())])

    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return ordered.mapInArrow(rows, "node string, ends_sha256 string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])


def _last(blocks: DataFrame) -> Column:
    names = [F.col(f"before_{m}").bitwiseXOR(F.col(m)) for m in ("m1", "m2")]
    return _name(F.col("total"), *names)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Trie of the given turns: (node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` are (conv, pos, total, digest, chars), ``convs`` all conversations (conv, total), also those without turns.

    Sums over subtrees need no walk: a node belongs to its smallest member, so the nodes of a conversation lie below each other.
    A subtree's sum is the sum of what its members own, less what its smallest member owns above it.
    """
    blocks = _blocks(turns)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), zero.alias("chars"), "n_convs", "conv_id")
    nodes = cut(_merged(blocks).union(root))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    sized = nodes.join(children, "node", "left").na.fill(0, ["n_children"])
    sized = cut(sized.withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_children") == 0).cast("long")}))
    owned = running(sized, "conv_id", "depth", ["saved", "leaf"])
    owns = sized.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    weighed = _folded(blocks.join(owns, "conv"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = _nodes(weighed, "saved", "leaf").groupBy("node").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"))
    below = below.union(owns.agg(F.lit(ROOT), F.sum("saved"), F.sum("leaf")))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = owned.join(below, "node").join(_ends(blocks, convs), "node", "left").join(above, "parent", "left")
    return found.select(
        "node",
        "parent",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("all_leaves") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations as they are; see :func:`numbered` for nulls and ties and :func:`trie` for columns."""
    turns = numbered(conversations)
    return trie(turns, turns.where("pos = 0").select("conv", "total"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations that share heads, one row per node, root included.

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).  Null turn: first; equal
    turns: by their digest; repeated rows are turns of their own; null role or text: empty; rows without conv_id are left out;
    conversations without turns are members of the root.  Further columns are ignored.  No rows: no rows, not even a root.
    """
    return trie(*rebuilt(numbered(conversations))).drop("node", "parent")
