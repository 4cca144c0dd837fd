"""Near-duplicate documents by min-max hashing, bands and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import xxhash

from readframe.llm.shared import GAP_CHARS, components, cut, join_back

SHINGLE = 5
MIN_SIMILARITY = 85  # in percent
#: Each permutation gives two signature values, so 126 evaluations of a shingle fill 42 bands of 6 values.  Sets that share
#: 80 % of their shingles then meet in no band three times in a million, at 85 % twice in a thousand million.
BANDS, ROWS = 42, 6
#: Shingles of the documents that one task compares with each other.
BLOCK_SHINGLES = 400_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_DRAWS = np.random.default_rng(85).integers(0, 2**63, (2, BANDS * ROWS // 2), np.int64).astype(np.uint64)
FACTORS, SHIFTS = (_DRAWS[0] << np.uint64(1)) | np.uint64(1), _DRAWS[1]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: runs of ``size`` words, or all words if there are fewer."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = np.lib.stride_tricks.sliding_window_view(hashed, min(size, len(hashed)))
    out = np.full(len(runs), len(hashed) if len(hashed) < size else size, np.uint64)
    for column in runs.T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xC2B2AE3D27D4EB4F))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the hashes under each permutation, the two next to each other."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    most = np.zeros(len(FACTORS), np.uint64)
    for at in range(0, len(hashes), 4096):
        # The upper half of the product depends on all bits of the hash.
        ranks = (hashes[at : at + 4096, None] * FACTORS + SHIFTS) >> np.uint64(20)
        least, most = np.minimum(least, ranks.min(axis=0)), np.maximum(most, ranks.max(axis=0))
    return np.stack([least, most], axis=1).ravel()


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: two hashes of its text, number of shingles, a 128-bit hash of their set, and the hashes of its bands (null if it has none)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text)
                if len(hashes):
                    rows_ = signature(hashes).reshape(BANDS, ROWS)
                    bands = [xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - 2**63 for k, r in enumerate(rows_)]
                    s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
                else:
                    bands, s1, s2 = None, None, None
                out.append((len(hashes), s1, s2, bands))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            same = [batch.column(c) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "bands"])

    asked = docs.select("doc_id", "text", *_text_hashes())
    return asked.mapInArrow(rows, f"doc_id {id_type}, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>")


def _text_hashes() -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")


def _linked(block: pd.DataFrame, least: int) -> list[tuple[int, int]]:
    """Pairs of documents that hold the block's documents together: enough links to connect whatever links connect.

    Intersections are counted over the shingles that at least two documents have, some thousand at a time as a matrix
    product; a pair already connected needs no link of its own.
    """
    sets = [np.frombuffer(b, np.uint64) for b in block["hashes"]]
    sizes = np.array([len(s) for s in sets])
    members = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[places]
    members, column = members[shared[places]], column[shared[places]]
    order = np.argsort(column, kind="stable")
    members, column = members[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, min(8192, 16_000_000 // max(1, len(sets))))
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        has = np.zeros((len(sets), width), np.float32)
        has[members[a:b], column[a:b] - k * width] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(100 * common >= least * union, 1))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, min_similarity: int = MIN_SIMILARITY, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Groups of documents connected by links: (doc_id, n_shingles, component_id, kept).

    Two documents are linked if 100 * shared shingles >= ``min_similarity`` * all their shingles.  Documents of equal sets
    go through as one.  Sets that share a band of their min-max signatures are candidates; candidates that hang together
    are compared on their full sets, in blocks of about ``block_shingles``, and only links that connect something are kept.
    ``component_id`` is the smallest doc_id of the group, ``kept`` marks its document.

    Null, empty or blank text: no shingles, linked with nothing, kept.  Null doc_id: linked like others, never kept unless
    its group has no doc_id at all.  Repeated doc_id: each row belongs to the group of its own text; all rows with the
    group's smallest doc_id are kept.  Further columns are ignored.  No rows: no rows.
    """
    known, named = _groups(docs, min_similarity, block_shingles)
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    out = known.select("doc_id", "n_shingles", "s1", "s2").join(join_back(named, least, "group").select("s1", "s2", "component_id"), ["s1", "s2"], "left")
    component = F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _groups(docs: DataFrame, min_similarity: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and the group of each set with its least doc_id and its first document."""
    known = cut(sketches(docs))
    # Documents of equal sets are one node, named by a hash of the set.
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2")
    one = known.where("s1 is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("first"), F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    banded = one.select("s1", F.posexplode("bands").alias("band", "value"))
    met = banded.groupBy("band", "value").agg(F.min("s1").alias("hub"), F.max("s1").alias("other")).where("hub != other")
    rough = cut(components(banded.join(met, ["band", "value"]).where("s1 != hub").select(F.col("s1").alias("a"), F.col("hub").alias("b"))))
    links = cut(_confirmed(docs, one, rough, min_similarity, block_shingles))
    named = one.join(components(links), F.col("s1") == F.col("node"), "left").select("s1", "s2", "first", "row", F.coalesce("component", "s1").alias("group"))
    return known, named


def _confirmed(docs: DataFrame, one: DataFrame, rough: DataFrame, least: int, most: int) -> DataFrame:
    """Links (a, b) between sets of one rough group, compared in full.

    A group beyond one block is cut into chunks.  Each chunk is compared with itself and two pivots of the group; where
    that connects nearly all, as it does in a large group of close copies, only the sets outside the largest part are
    left to be compared with all chunks.  Pairs inside one part are connected already and need no comparison.
    """
    asked = one.select("s1", "row", "n").join(rough, F.col("s1") == F.col("node")).select("s1", "row", "n", F.col("component").alias("g"))
    loads = asked.groupBy("g").agg(
        F.greatest(F.ceil(F.sum("n") / most), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("chunks"), F.min("s1").alias("p1"), F.max("s1").alias("p2")
    )
    placed = join_back(asked, loads, "g").withColumn("chunk", F.pmod(F.xxhash64("s1"), F.col("chunks")).cast("int"))
    full = cut(_texts(docs, placed).select("g", "s1", "chunk", "chunks", "p1", "p2", "text").mapInArrow(_sets, SET))

    pivot = (F.col("s1") == F.col("p1")) | (F.col("s1") == F.col("p2"))
    own = F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    compare = _comparer(least)
    # One name for a block: by several columns Spark would leave a group where a join has put it, in one task.
    cell = F.concat_ws(":", "g", "i", "j").alias("cell")
    first = full.select("g", F.explode(own).alias("i"), F.lit(0).alias("j"), "s1", "hashes").groupBy(cell).applyInPandas(compare, LINK)

    large = full.where("chunks > 1")
    if large.isEmpty():
        return first
    first = cut(first)
    part = large.select("g", "s1", "chunk", "chunks", "hashes").join(components(first), F.col("s1") == F.col("node"), "left").withColumn("part", F.coalesce("component", "s1"))
    main = part.groupBy("g", "part").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    part = cut(join_back(part, main, "g"))  # kept, as a plan of all these joins takes the optimizer too long
    apart = part.where("part != main")
    slices = apart.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("slices"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i")
    left = join_back(apart, slices, "g").select("g", every, F.pmod(F.xxhash64("s1", F.lit(1)), F.col("slices")).cast("int").alias("j"), "s1", "hashes")
    right = join_back(part, slices, "g").select("g", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j"), "s1", "hashes")
    return first.union(left.union(right).groupBy(cell).applyInPandas(compare, LINK))


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The text of each set, from its first document.

    A document is found again by its id and text together, so rows of one id, or of none, meet only where their texts
    are equal.
    """
    texts = docs.select("text", "doc_id", *_text_hashes()).select("text", _row_name("doc_id", "t1", "t2"))
    return sets.withColumn("_name", _row_name("row.doc_id", "row.t1", "row.t2")).join(texts, "_name")


SET, LINK = "g long, s1 long, chunk int, chunks int, p1 long, p2 long, hashes binary", "a long, b long"
BLOCK_SETS = 1024


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each text, once in a task, however many equal rows it has."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for at, s1 in enumerate(batch.column("s1").to_pylist()):
            if s1 not in seen:
                seen.add(s1)
                new.append(at)
        batch = batch.take(pa.array(new, pa.int64()))
        sets = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], sets], [*batch.schema.names[:6], "hashes"])


def _comparer(least: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("s1").sort_values("s1")
        ids, pairs = group["s1"].to_numpy(), _linked(group, least) if len(group) > 1 else []
        return pd.DataFrame({"a": [ids[x] for x, _ in pairs], "b": [ids[y] for _, y in pairs]}, dtype="int64")

    return compare


def first_of_group(docs: DataFrame, min_similarity: int = MIN_SIMILARITY, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Exactly one row of each group, with its own columns.

    The one with the least doc_id, null last, then by hashes of the text; of rows with equal doc_id and text, one.  Rows
    without a word are groups of their own, so all of them stay.
    """
    named = _groups(docs, min_similarity, block_shingles)[1]
    first = named.groupBy("group").agg(F.min("row").alias("row")).select(_row_name("row.doc_id", "row.t1", "row.t2"))
    blank = F.length(F.translate(F.coalesce("text", F.lit("")), GAP_CHARS, "")) == 0
    rows = docs.where(~blank).select(F.struct("*").alias("doc"), "doc_id", *_text_hashes())
    found = rows.withColumn("_name", _row_name("doc_id", "t1", "t2")).join(first, "_name", "left_semi")
    # Equal rows meet in their tasks first, so that many copies of one row do not meet in one.
    single = found.groupBy("doc_id", "t1", "t2").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return single.select("doc.*").union(docs.where(blank))


def _row_name(doc_id: str, t1: str, t2: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), t1, t2).alias("_name")
