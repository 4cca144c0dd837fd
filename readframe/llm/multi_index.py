"""Nearest vectors by inner product with multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from readframe.llm.shared import cut

#: Rows that the rotations and the radius are learned from, whatever the size of the table.
SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS, ITERATIONS = 4, 20
SUBSTRING_BITS = 16
#: Share of true neighbours in the sample that the radius has to take in.
COVER = 0.985
INDEX_BLOCK, QUERY_BLOCK = 32_768, 4096

BITS_IN = np.array([bin(x).count("1") for x in range(1 << SUBSTRING_BITS)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """Rotations that turn a vector into bits, and the Hamming radius in which neighbours lie.

    Inner products order like angles once each candidate gets one more component that brings it to the longest norm, and
    each query a zero there; codes are the signs of such vectors under rotations learned to lose little by rounding.
    """

    longest: float
    rotations: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Substrings of each code as 16-bit numbers."""
        bits = self._lifted(vectors, queries) @ self.rotations > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING_BITS)))
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def _lifted(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        if queries:
            return np.hstack([vectors / norms, np.zeros_like(norms)])
        vectors = vectors / self.longest
        return np.hstack([vectors, np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))])


def learn(sample: np.ndarray, longest: float, k: int, rotations: int = ROTATIONS, seed: int = 8) -> Codes:
    """Rotations by alternating between the nearest corners of the cube and the best rotation onto them."""
    rng = np.random.default_rng(seed)
    plain = Codes(longest, np.zeros((sample.shape[1] + 1, 1)), 0)
    lifted = plain._lifted(sample, queries=False)
    found = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((lifted.shape[1], lifted.shape[1])))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(lifted.T @ np.sign(lifted @ turn), full_matrices=False)
            turn = u @ v
        found.append(turn)
    codes = Codes(longest, np.hstack(found), 0)
    asked = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if not near.size:
        return codes
    ours, theirs = codes.of(asked, True), codes.of(sample, False)
    far = np.sort(BITS_IN[ours[:, None, :] ^ theirs[near]].sum(axis=2, dtype=np.int64).ravel())
    return Codes(longest, codes.rotations, int(far[int(np.ceil(COVER * (len(far) - 1)))]))


class Index:
    """Codes of one block, with a table for each substring from its value to the codes that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(column, return_inverse=True) for column in codes.T]

    def within(self, query: np.ndarray, radius: int, at_least: int) -> np.ndarray:
        """Codes in the Hamming radius; the radius grows until ``at_least`` are found or all are.

        If two codes differ in at most r bits, then for any limits that add up, each plus one, to r + 1 one of their
        substrings differs in at most its limit.  So the buckets within the limits hold every code in the radius; those
        they hold beyond it fall out by the whole code.
        """
        m, bits = len(self.tables), SUBSTRING_BITS * len(self.tables)
        while True:
            limits = (radius + 1) // m - 1 + (np.arange(m) < (radius + 1) % m)
            probed = np.zeros(len(self.codes), bool)
            for (values, where), own, limit in zip(self.tables, query, limits, strict=True):
                if limit >= 0:
                    probed |= (BITS_IN[values ^ own] <= limit)[where]
            found = np.flatnonzero(probed)
            found = found[BITS_IN[self.codes[found] ^ query].sum(axis=1, dtype=np.int64) <= radius]
            if len(found) >= min(at_least, len(self.codes)) or radius >= bits:
                return found
            radius = min(bits, radius + m)


def _vectors(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector as bytes of doubles) that take part: finite, not zero, and of the commonest length."""
    v = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(whole)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    n = sizes[0]["n"] if sizes else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())], ["vec_id", "vector"])

    return rows.where(F.size("embedding") == n).mapInArrow(pack, "vec_id long, vector binary")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, index_block: int = INDEX_BLOCK) -> DataFrame:
    """Nearest vectors of each query by inner product: (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own.  Rotations and
    radius are learned from at most 8192 rows picked by a hash of their id; every row is indexed.  Blocks of queries meet
    blocks of the index: probing finds the codes in the radius, and what it finds is ranked by the inner product of the
    original vectors in double precision, ties to the smaller vec_id.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, and
    neither do rows without vec_id.  Repeated vec_id: a query row gives one list for its id from its smallest vector; rows
    with the query's id are no candidates of it; other repeated rows are listed each.  Further columns are ignored.  No
    rows, or a single one: no rows.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = F.lit(min(1.0, SAMPLE * 1.2 / total))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(picked):
        picked = rows.limit(SAMPLE).toPandas()
    longest = rows.mapInArrow(_longest, "norm double").agg(F.max("norm")).first()[0]
    codes = learn(_vectors(picked["vector"].tolist()), longest, k)

    n_index = -(-total // index_block)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_query = -(-asked.count() // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    index = rows.select(block(n_index).alias("i"), every_block(n_query).alias("q"), "vec_id", "vector")
    queries = asked.select(every_block(n_index).alias("i"), block(n_query).alias("q"), "vec_id", "vector")

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, data = block["vec_id"].to_numpy(), _vectors(block["vector"].tolist())
        index = Index(codes.of(data, False))
        own, wanted = queries["vec_id"].to_numpy(), _vectors(queries["vector"].tolist())
        out = []
        for q, vector, code in zip(own, wanted, codes.of(wanted, True), strict=True):
            near = index.within(code, codes.radius, k + 1)
            near = near[ids[near] != q]
            scores = (data[near] * vector).sum(axis=1)
            best = _best(scores, ids[near], k)
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    found = queries.groupBy("i", "q").cogroup(index.groupBy("i", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            norms = np.linalg.norm(_vectors(batch.column("vector").to_pylist()), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([float(norms.max())])], ["norm"])
