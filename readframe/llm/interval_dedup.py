"""Removing byte strings that occur earlier, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readframe.llm.repeats import Repeats, covered, keyed

MIN_BYTES = 100
#: Symbols compared at once when suffixes are first sorted; nine bits each, seven fit in a word.
WORD = 7


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the sorted length until all differ; only ties are sorted again."""
    n = len(symbols)
    padded = np.r_[symbols, np.zeros(WORD, np.int64)]
    words = np.zeros(n, np.int64)
    for k in range(WORD):
        words = (words << 9) | padded[k : k + n]
    order = np.argsort(words)
    new = np.r_[True, words[order[1:]] != words[order[:-1]]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length, tied = WORD, np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(tied):
        members = order[tied]
        behind = rank[np.minimum(members + length, n)] + 1
        keys = rank[members] * (n + 1) + behind
        by_key = np.argsort(keys)
        members, keys = members[by_key], keys[by_key]
        order[tied] = members
        new = np.r_[True, keys[1:] != keys[:-1]]
        rank[members] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        length *= 2
    return order


def long_prefix_classes(joined: np.ma.MaskedArray, starts: np.ndarray, width: int) -> np.ndarray:
    """A number for the suffix at each start, equal for suffixes that share their first ``width`` symbols.

    Common prefixes are derived by increasing length: the interval of a string in the suffix array is extended backward by
    each letter that precedes it; where the interval found ends at a place without a value yet, neighbours there share
    exactly the string's length, and the interval joins the queue of the next length.  The queue begins with the words that
    the first sort compared, and ends at ``width``: places without a value then share more.  Positions between texts hold
    zero, which no string crosses.
    """
    symbols = np.where(joined.mask, 0, joined.data.astype(np.int64) + 1)
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1]
    by_letter = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one letter longer stands
    step[by_letter] = np.arange(n)
    same = before[by_letter[1:]] == before[by_letter[:-1]]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # places with the same letter before them
    following[by_letter[:-1][same]] = by_letter[1:][same]
    preceding[by_letter[1:][same]] = by_letter[:-1][same]

    padded = np.r_[symbols, np.zeros(WORD, np.int64)]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    for k in range(WORD):
        letters = padded[order + k]
        known[1:n] |= letters[1:] != letters[:-1]
    left = np.flatnonzero(known[:n])
    right = np.r_[left[1:], n] - 1
    for _ in range(WORD, width):
        sizes = right - left + 1
        places = np.arange(int(sizes.sum())) + np.repeat(left - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        letters = before[places] > 0
        lasts = np.sort(step[places[letters & (following[places] > np.repeat(right, sizes))]])
        firsts = np.sort(step[places[letters & (preceding[places] < np.repeat(left, sizes))]])
        fresh = ~known[lasts + 1]
        left, right = firsts[fresh], lasts[fresh]
        known[right + 1] = True
        if not len(left):
            break
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.cumsum(known[:n])[place[starts]]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def repeats(width: int = MIN_BYTES) -> Repeats:
    return Repeats(width=width, gram=max(1, width // 4), own=True, symbols=_bytes, classes=long_prefix_classes)


def remove_repeated_bytes(docs: DataFrame, width: int = MIN_BYTES, with_text: bool = False) -> DataFrame:
    """Every byte covered by a string of ``width`` bytes that starts earlier is removed from its document.

    Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with ``with_text`` the kept bytes.  Earlier means a smaller
    doc_id, or the same document and an earlier start; strings are judged on the input.

    Null or empty text: 0 bytes.  Shorter texts lose nothing.  Null doc_id: after all others.  Rows with equal doc_id: rows
    of equal text are one document and get the same result each; rows of different text come in the order of a hash of
    the text.  Further columns are ignored.  No rows: no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, flags, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "flags", "spans")), strict=True):
                data = text.encode()
                gone = covered(flags, spans)
                ends = [0, *(b for _, b in gone)]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_text else 4]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return repeats(width).spans(keyed(docs)).select("doc_id", "text", "flags", "spans").mapInArrow(rows, schema)
