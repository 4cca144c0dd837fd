"""Removing word sequences that occur in earlier documents, by suffix trees of prefix groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

import xxhash

from readframe.llm.repeats import Repeats, covered, keyed

MIN_WORDS = 13
#: Suffixes of one subtree.
GROUP = 50_000


def deep_nodes(joined: np.ma.MaskedArray, starts: np.ndarray, width: int, group: int = GROUP) -> np.ndarray:
    """For each suffix, the tree node at depth ``width`` that it hangs under; a number of its own if it is alone there.

    Suffixes are parted by their first word; parts of more than ``group`` suffixes by one more word, and so on, so that
    prefixes are as long as memory asks.  The subtree of a part is built from its suffixes in order: neighbours that agree
    in their first ``width`` words hang under one node, and the words above it repeat.
    """
    letters = np.unique(joined.data, return_inverse=True)[1]
    nodes = np.full(len(starts), -1)
    made, parts = 0, [(np.arange(len(starts)), 0)]
    while parts:
        part, depth = parts.pop()
        if len(part) > group and depth < width:
            words = letters[starts[part] + depth]
            order = np.argsort(words, kind="stable")
            cuts = np.flatnonzero(np.r_[True, words[order[1:]] != words[order[:-1]]])
            parts += [(p, depth + 1) for p in np.split(part[order], cuts[1:])]
            continue
        rows = np.stack([letters[starts[part] + k] for k in range(depth, width)], axis=1) if depth < width else np.zeros((len(part), 0))
        order = np.lexsort(rows.T[::-1]) if depth < width else np.arange(len(part))
        agree = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        nodes[part[order]] = made + np.cumsum(np.r_[0, ~agree])
        made += len(part)
    return nodes


def _hash_words(text: str) -> np.ndarray:
    words = text.encode().split()  # on the six characters that separate words
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def repeats(width: int = MIN_WORDS) -> Repeats:
    return Repeats(width=width, gram=max(1, width // 3), own=False, symbols=_hash_words, classes=deep_nodes)


def remove_repeated_words(docs: DataFrame, width: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """Every word covered by a window of ``width`` words that also starts in a document with a smaller doc_id is removed.

    Rows (doc_id, n_words, n_removed, kept_sha256), and with ``with_text`` the kept words joined by one space.  Windows are
    judged on the input.

    Null, empty or blank text: no words.  Shorter texts lose nothing.  Null doc_id: after all others.  Rows with equal
    doc_id repeat nothing of each other.  Further columns are ignored.  No rows: no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, flags, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "flags", "spans")), strict=True):
                words = text.encode().split()
                gone = covered(flags, spans)
                ends = [0, *(b for _, b in gone)]
                kept = [w for a, b in zip(ends, [*(a for a, _ in gone), len(words)], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if with_text else 3]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4]
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return repeats(width).spans(keyed(docs)).select("doc_id", "text", "flags", "spans").mapInArrow(rows, schema)
