"""Packing token sequences: dominance reduction first, then best fit for the rest."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from readframe.llm.shared import cut, parts_of

CAPACITY = 2048
END_ID = 0
#: Fixed value: the vocabulary's one special token, which the tokenizer finds inside texts as well.
SPECIAL = "<|endoftext|>"


@cache
def _encoders(tokenizer: str, ranks: str):
    import base64

    import public_tokenizers
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Tokenizer.from_file(tokenizer), Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encoded(text: str, tokenizer: str, ranks: str) -> bytes:
    """Ids of a text as little-endian 32-bit bytes.

    The tokenizer's vocabulary as ranks gives the same ids four times as fast; only a text with the special token's
    string, which ranks do not know, goes through the tokenizer itself.
    """
    whole, fast = _encoders(tokenizer, ranks)
    if SPECIAL in text:
        return np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def tokenized_pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids and a closing 0, in pieces of at most ``capacity``: (doc_id, piece, start, length, ids_crc32).

    Only longer documents are cut, the first piece taking what is over.  ``with_ids`` adds the ids as 32-bit bytes.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"doc_id": pa.int32() if id_type == "int" else pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    names = list(kinds)[: 6 if with_ids else 5]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoded(text or "", tokenizer, ranks) + END_ID.to_bytes(4, "little")
                n, at = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = min(capacity, (n - 1) % capacity + 1) if piece == 0 else capacity
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, piece, at, length, zlib.crc32(part), part))
                    at += length
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=False)], names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


class Plan:
    """Which sequence takes the n-th piece of a length; made from the number of pieces of each length alone.

    Its tables have about as many entries as there are lengths, whatever the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: k for n, k in counts.items() if k}
        self.given = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.moves: list[tuple[int, int, int, int, int]] = []  # length, first rank, number, first sequence, offset
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.moves.append((length, self.given[length], number, sequence, offset))
        self.given[length] += number
        self.left[length] -= number

    def _fix(self, lengths: list[int], number: int) -> None:
        offset = 0
        for length in lengths:
            self._put(length, number, self.sequences, offset)
            offset += length
        self.sequences += number

    def _reduce(self) -> None:
        """Fix sets that dominate every other set with their longest piece, so that some best packing has them."""
        for longest in sorted(self.left, reverse=True):
            while self.left[longest] and (chosen := self._dominating(longest)):
                used = {x: chosen.count(x) for x in chosen}
                self._fix(chosen, min(self.left[x] // k for x, k in used.items()))

    def _dominating(self, longest: int) -> list[int] | None:
        room = self.capacity - longest
        stock = lambda x: self.left.get(x, 0) - (x == longest)
        if stock(room) > 0:
            return [longest, room]  # it fills the room, so whatever else shared it fits in its place
        lengths = [x for x in sorted(self.left) if x <= room and stock(x) > 0]
        if not lengths:
            return [longest]  # nothing else fits
        best = lengths[-1]
        least = [x for x in lengths[:3] for _ in range(min(3, stock(x)))][:3]
        if len(least) < 2 or sum(least[:2]) > room:
            return [longest, best]  # one more at most, and this is the longest
        if len(least) == 3 and sum(least) <= room:
            return None
        pairs = [(x, y) for x in lengths if (y := _largest(lengths, min(x, room - x), lambda y, x=x: stock(y) > (x == y))) is not None]
        if max(x + y for x, y in pairs) <= best:
            return [longest, best]  # any pair fits in the place of the longest one
        second = next((y for x, y in pairs if x == best), None)
        if second is None:
            return None
        above = [y for x, y in pairs if y > second and x + y > best]
        return [longest, best, second] if not above else None

    def _best_fit(self) -> None:
        """Longest first, each piece into the fullest sequence that has room, many sequences of one kind at a time."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, number)
        rooms: list[int] = []
        for length in sorted((x for x, k in self.left.items() if k), reverse=True):
            while self.left[length]:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    number = -(-self.left[length] // (self.capacity // length))
                    room, first = self.capacity, self.sequences
                    self.sequences += number
                else:
                    room = rooms[at]
                    first, number = open_[room].pop()
                    if number > self.left[length]:
                        open_[room].append((first + self.left[length], number - self.left[length]))
                        number = self.left[length]
                    if not open_[room]:
                        del open_[room], rooms[at]
                self._put(length, number, first, self.capacity - room)
                if rest := room - length:
                    if rest not in open_:
                        insort(rooms, rest)
                    open_.setdefault(rest, []).append((first, number))

    def tables(self) -> dict[int, np.ndarray]:
        """For each length: rows (first rank, first sequence, offset) by rank."""
        out: dict[int, list] = {}
        for length, rank, _, sequence, offset in self.moves:
            out.setdefault(length, []).append((rank, sequence, offset))
        return {n: np.array(sorted(rows), np.int64) for n, rows in out.items()}


def _largest(lengths: list[int], limit: int, fits) -> int | None:
    for k in range(bisect_right(lengths, limit) - 1, -1, -1):
        if fits(lengths[k]):
            return lengths[k]
    return None


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank among those of equal length, counted in parts so that no length meets in one task."""
    parts = parts_of(pieces.sparkSession)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    bases = counts.select("length", "part", before.alias("base"))
    return pieces.withColumn("rank", inside - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base", "part")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the sequence that takes them and their place there: adds (sequence_id, offset).

    The packing is planned from the number of pieces of each length; those numbers, at most ``capacity`` of them, are all
    that comes to the driver.
    """
    # Far fewer files than scan tasks: what is kept of a text is some numbers.
    pieces = cut(pieces.repartition(parts_of(pieces.sparkSession, 4)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    tables = Plan(counts, capacity).tables()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                of, table = length == n, tables[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[of], side="right") - 1]
                sequence[of], offset[of] = row[:, 1] + rank[of] - row[:, 0], row[:, 2]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    order = ranked(pieces).select(*pieces.columns, "rank")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return order.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as found.

    Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.  Sets of pieces that dominate all
    alternatives are fixed first (a piece and its exact complement, a piece that nothing fits beside, a longest partner
    where only one fits, pairs where only two fit); the rest goes longest first to the fullest sequence with room.

    Null or empty text: one piece with the closing 0 only.  Null or repeated doc_id: pieces of their own for each input
    row.  Equal lengths: by a hash of the piece.  Further columns are ignored.  No rows: no rows.
    """
    return pack(tokenized_pieces(docs, tokenizer, ranks, capacity), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids as 32-bit bytes), from placed pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
