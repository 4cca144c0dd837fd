"""Finding windows that repeat across documents without a row per window.

Every window of ``width`` symbols (bytes or words) is named after its minimizer, the gram of ``gram`` symbols in it with the
least hash, the leftmost of equals.  Neighbouring windows with the same minimizer make a segment, so a text falls into
segments that overlap by ``width - 1`` symbols, each window lies in exactly one, and equal windows lie in segments with
equal minimizers.  Only hashes of segments are shuffled at first.  A segment that is equal to an earlier one is covered
whole; one whose minimizer no other segment has repeats nothing; only the rest, a small part of a corpus, has its
symbols brought together, and there an exact method compares windows.

Hot groups: segments that are equal inside one task are reduced before the shuffle; a minimizer with very many different
segments is spread over all tasks by the hash of the single window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import xxhash

#: Symbols and documents that a task splits at a time; documents fit in 16 bits.
FLUSH_SYMBOLS, FLUSH_DOCS = 6_000_000, 50_000
#: Lower bits of a gram's hash that give way to its place while minimizers are found, over so many grams at a time.
PLACE_BITS = 24
#: A minimizer with more different segments than this is spread by window.
HOT = 4_096
GONE, SHARED, SPREAD = 0, 1, 2
LAST_ID = 2**63 - 1  # stands for a null doc_id, which comes last

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
RECORD = np.dtype([("content", "<u8"), ("minimizer", "<u8"), ("at", "<u4"), ("n", "<u2"), ("doc", "<u2"), ("gone", "u1")])
FLAG = np.dtype([("at", "<u4"), ("n", "<u2"), ("kind", "u1")])
SEGMENT = np.dtype([("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("n", "<u2"), ("active", "<u2"), ("minimizer", "<u8")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


@dataclass(frozen=True)
class Repeats:
    """What counts as a repeat.

    ``symbols`` turns a text into an array of unsigned integers.  ``own`` tells whether a window that repeats inside its own
    document counts, so that the earliest (document, start) stays; otherwise all windows of the first document stay.
    ``classes`` gets symbols and window starts, and gives each window a class, equal only for equal windows.
    """

    width: int
    gram: int
    own: bool
    symbols: Callable[[str], np.ndarray]
    classes: Callable[[np.ndarray, np.ndarray, int], np.ndarray]

    def spans(self, texts: DataFrame) -> DataFrame:
        """Per document, its covered stretches: (d, t, flags, spans), to be read by :func:`covered`.

        ``texts`` has (d, t, text): an id without nulls, a hash of the text, the text.
        """
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        split = texts.mapInArrow(self._split(parts), "bucket int, payload binary").repartition(parts, "bucket")
        flags = _by_document(split.mapInArrow(self._judge(parts), "bucket int, payload binary"), parts, "flags")
        flagged = texts.join(flags, ["d", "t"], "left")
        segments = flagged.mapInArrow(self._fetch(parts), "bucket int, payload binary").repartition(parts, "bucket")
        spans = _by_document(segments.mapInArrow(self._compare(parts), "bucket int, payload binary"), parts, "spans")
        return flagged.join(spans, ["d", "t"], "left")

    # Each text into segments, and their hashes into buckets by minimizer.
    def _split(self, parts: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}  # rows of equal id and text are one document
            n = 0
            for batch in batches:
                for d, t, text in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "text")), strict=True):
                    if (d, t) in held:
                        continue
                    symbols = self.symbols(text)
                    if len(symbols) < self.width:
                        continue
                    held[d, t] = symbols
                    n += len(symbols)
                    if n >= FLUSH_SYMBOLS or len(held) >= FLUSH_DOCS:
                        yield _payloads(self._records(held, parts))
                        held, n = {}, 0
            if held:
                yield _payloads(self._records(held, parts))

        return rows

    def _records(self, held, parts: int) -> Iterator[tuple[int, bytes]]:
        held = sorted(((d, t, symbols) for (d, t), symbols in held.items()), key=lambda x: x[:2])
        d, t = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        symbols = np.concatenate([x[2] for x in held])
        ends = np.cumsum([len(x[2]) for x in held])
        starts = ends - [len(x[2]) for x in held]
        out = []
        for lo, hi in _runs(starts, ends):
            first, last, minimizer, doc = split_windows(symbols[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo], self.width, self.gram)
            record = np.zeros(len(first), RECORD)
            record["content"] = _hashes(symbols, first + starts[lo], last + self.width + starts[lo])
            record["minimizer"], record["doc"] = minimizer, doc + lo
            record["at"], record["n"] = first - (starts[lo:hi] - starts[lo])[doc], last - first + self.width
            out.append(record)
        records = np.concatenate(out)
        # Equal segments of one task: only the first goes on, or in the other mode those of the first document.
        order = np.lexsort((records["at"], records["doc"], records["content"], records["minimizer"]))
        records = records[order]
        records["gone"] = ~_firsts(records, d[records["doc"]], t[records["doc"]], self.own)
        bucket = (records["minimizer"] % np.uint64(parts)).astype(np.int64)
        bucket = np.where(records["gone"], (d[records["doc"]] ^ t[records["doc"]]) % parts, bucket)
        records["content"][records["gone"] == 1] = 0
        records["minimizer"][records["gone"] == 1] = 0
        # A minimizer with very many segments here: they go on by their own hash, and one mark by the minimizer.
        same = np.flatnonzero(np.r_[True, records["minimizer"][1:] != records["minimizer"][:-1]])
        sizes = np.diff(np.r_[same, len(records)])
        hot = np.repeat((sizes > HOT) & (records["minimizer"][same] != 0), sizes)
        marks = records[same[(sizes > HOT) & (records["minimizer"][same] != 0)]].copy()
        marks["gone"] = 2
        bucket = np.where(hot, (records["content"] % np.uint64(parts)).astype(np.int64), bucket)
        records["gone"][hot] = 3
        records, bucket = np.concatenate([records, marks]), np.concatenate([bucket, (marks["minimizer"] % np.uint64(parts)).astype(np.int64)])
        order = np.lexsort((records["doc"], bucket))
        records, bucket = records[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = records[lo:hi].copy()
            docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
            columns = [np.array([len(docs), len(part)], "<i8"), d[docs], t[docs], *(part[c] for c in RECORD.names)]
            yield int(bucket[lo]), b"".join(np.ascontiguousarray(c).tobytes() for c in columns)

    # Segments with the same minimizer meet: which are covered whole, which share their minimizer.
    def _judge(self, parts: int):
        return lambda batches: self._judged(batches, parts)

    def _judged(self, batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        met = [_unpacked(p) for batch in batches for p in batch.column("payload").to_pylist()]
        if not met:
            return
        d, t, records = (np.concatenate([p[k] for p in met]) for k in range(3))
        del met
        marked, real = np.unique(records["minimizer"][records["gone"] == 2]), records["gone"] != 2
        d, t, records = d[real], t[real], records[real]
        if not len(records):
            return
        order = np.lexsort((records["at"], t, d, records["content"], records["minimizer"]))
        d, t, records = d[order], t[order], records[order]
        gone = records["gone"] == 1
        first = _firsts(records, d, t, self.own)
        fresh = np.r_[True, (records["content"][1:] != records["content"][:-1]) | (records["minimizer"][1:] != records["minimizer"][:-1])]
        group = np.cumsum(np.r_[True, records["minimizer"][1:] != records["minimizer"][:-1]]) - 1
        different = np.bincount(group, weights=fresh)
        hot = (np.bincount(group, weights=records["gone"] == 3) > 0) | np.isin(records["minimizer"][np.r_[True, np.diff(group) > 0]], marked)
        kind = np.where(hot | (different > HOT), SPREAD, np.where(different > 1, SHARED, 255))[group]
        kind = np.where(gone | ~first, GONE, kind)
        keep = kind != 255
        flags = np.zeros(int(keep.sum()), FLAG)
        flags["at"], flags["n"], flags["kind"] = records["at"][keep], records["n"][keep], kind[keep]
        yield from _documents(d[keep], t[keep], flags, parts)

    # Symbols of the segments that share their minimizer.
    def _fetch(self, parts: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fetched: set[tuple[int, int]] = set()
            for batch in batches:
                out: dict[int, list[tuple[bytes, bytes]]] = {}
                for d, t, text, flags in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "text", "flags")), strict=True):
                    flags = np.frombuffer(flags or b"", FLAG)
                    flags = flags[flags["kind"] != GONE]
                    if len(flags) and (d, t) not in fetched:
                        fetched.add((d, t))
                        for bucket, head, symbols in self._segments(d, t, self.symbols(text), flags, parts):
                            out.setdefault(bucket, []).append((head, symbols))
                if out:
                    yield _payloads((b, np.int64(len(x)).tobytes() + b"".join(h for h, _ in x) + b"".join(s for _, s in x)) for b, x in out.items())

        return rows

    def _segments(self, d: int, t: int, symbols: np.ndarray, flags: np.ndarray, parts: int):
        data, size = symbols.tobytes(), symbols.itemsize
        minimizers = least_grams(symbols, flags["at"].astype(np.int64), self.width, self.gram)[1]
        for (at, n, kind), minimizer in zip(flags.tolist(), minimizers.tolist(), strict=True):
            if kind == SHARED:
                pieces = [(at, n, minimizer)]
            else:  # by window, as many windows of the same minimizer differ
                pieces = [(k, self.width, xxhash.xxh3_64_intdigest(data[k * size : (k + self.width) * size])) for k in range(at, at + n - self.width + 1)]
            for k, m, key in pieces:
                yield key % parts, np.array((d, t, k, m, m - self.width + 1, key), SEGMENT).tobytes(), data[k * size : (k + m) * size]

    # Windows of segments with the same key meet.
    def _compare(self, parts: int):
        return lambda batches: self._compared(batches, parts)

    def _compared(self, batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        kind = self.symbols("").dtype
        heads, data = [], []
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                n = int(np.frombuffer(payload, "<i8", 1)[0])
                heads.append(np.frombuffer(payload, SEGMENT, n, 8))
                data.append(np.frombuffer(payload, kind, -1, 8 + n * SEGMENT.itemsize))
        if not heads:
            return
        head, symbols = np.concatenate(heads), np.concatenate(data)
        begin = np.cumsum(head["n"], dtype=np.int64) - head["n"]
        order = np.argsort(head["minimizer"], kind="stable")
        for block in _blocks(head["minimizer"][order], head["n"][order]):
            part = order[block]
            yield from self._covered(head[part], [symbols[b : b + n] for b, n in zip(begin[part], head["n"][part], strict=True)], parts)

    def _covered(self, head: np.ndarray, pieces: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
        agreeing = np.flatnonzero(may_share_window(head["minimizer"], pieces, self.width, self.gram))
        if not len(agreeing):
            return
        head, pieces = head[agreeing], [pieces[k] for k in agreeing]
        active = head["active"].astype(np.int64)
        # One place is left free behind each segment; see the methods for what they put there.
        begin = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
        of = np.repeat(np.arange(len(head)), active)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(active) - active, active)
        joined = np.zeros(int(begin[-1]) + len(pieces[-1]) + 1, pieces[0].dtype)
        gaps = np.ones(len(joined), bool)
        for b, p in zip(begin, pieces, strict=True):
            joined[b : b + len(p)] = p
            gaps[b : b + len(p)] = False
        names = self.classes(np.ma.MaskedArray(joined, gaps), begin[of] + inside, self.width)
        d, t, at = head["doc"][of], head["text"][of], head["at"][of] + inside
        order = np.lexsort((at, t, d, names))
        d, t, at, names = d[order], t[order], at[order], names[order]
        new = np.r_[True, names[1:] != names[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        # Rows of equal id and text may come from several tasks; a window does not repeat itself.
        gone = d != d[start]
        if self.own:
            gone |= (t != t[start]) | (at != at[start])
        spans = np.zeros(int(gone.sum()), SPAN)
        spans["start"], spans["end"] = at[gone], at[gone] + self.width
        yield from _documents(d[gone], t[gone], spans, parts)


def split_windows(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Segments of documents laid one after another: first and last window, minimizer, document."""
    grams = gram_hashes(symbols.astype(np.uint64), gram)
    place = _least_places(grams, width - gram + 1)
    n = len(place)
    whole = np.zeros(n + 1, np.int32)
    np.add.at(whole, starts, 1)
    np.add.at(whole, ends - width + 1, -1)
    opens = np.r_[True, place[1:] != place[:-1]]
    opens[starts] = True
    first = np.flatnonzero(opens & (np.cumsum(whole[:-1]) > 0))
    doc = np.searchsorted(starts, first, side="right") - 1
    last = np.minimum(np.r_[first[1:], n] - 1, ends[doc] - width)
    return first, last, grams[place[first]], doc


def _least_places(grams: np.ndarray, reach: int) -> np.ndarray:
    """Where the least gram of each run of ``reach`` grams stands, however many grams there are."""
    out, most = [], 1 << PLACE_BITS
    for lo in range(0, len(grams) - reach + 1, most - reach + 1):
        part = grams[lo : lo + most]
        # Of equal hashes in their upper bits the leftmost is least, as the lower bits hold the place.
        least = (part & ~_place_mask()) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        out.append((least & _place_mask()).astype(np.int64) + lo)
    return np.concatenate(out)


def _place_mask() -> np.uint64:
    return np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` symbols, built from halves."""
    hashes, span, k = (symbols + np.uint64(1)) * MIX[0], 1, 1
    while span < gram:
        step = min(span, gram - span)
        hashes = hashes[:-step] * MIX[k % len(MIX)] + hashes[step:]
        hashes ^= hashes >> np.uint64(29)
        span, k = span + step, k + 1
    hashes *= MIX[0]
    return hashes ^ (hashes >> np.uint64(32))


def least_gram(grams: np.ndarray) -> int:
    return int(np.argmin(grams & ~_place_mask()))


def _runs_at(symbols: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` symbols from each start on, one run behind the other."""
    return symbols[(starts[:, None] + np.arange(n)).ravel()].astype(np.uint64)


def least_grams(symbols: np.ndarray, starts: np.ndarray, width: int, gram: int, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Of the window at each start, where its minimizer stands in it, and the minimizer; so many windows at a time."""
    places, least = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.uint64)
    for lo in range(0, len(starts), most):
        some = starts[lo : lo + most]
        grams = np.zeros(len(some) * width, np.uint64)
        grams[: len(grams) - gram + 1] = gram_hashes(_runs_at(symbols, some, width), gram)
        grams = grams.reshape(-1, width)[:, : width - gram + 1]
        places[lo : lo + most] = at = np.argmin(grams & ~_place_mask(), axis=1)
        least[lo : lo + most] = grams[np.arange(len(some)), at]
    return places, least


def may_share_window(keys: np.ndarray, pieces: list[np.ndarray], width: int, gram: int) -> np.ndarray:
    """Which pieces can have a window in common with another one of their key; keys come in groups.

    Equal windows hold their minimizer at the same place, and of the symbols beside it one half at least on the left or the
    other half at least on the right.  A piece that agrees on neither half with another piece of its key repeats nothing.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    symbols, begin = np.concatenate(pieces), np.cumsum(sizes) - sizes
    place = least_grams(symbols, begin, width, gram)[0]
    left = (width - gram + 1) // 2
    right = width - gram + 1 - left
    agrees = np.zeros(len(pieces), bool)
    for n, first, fits in ((left, place - left, place >= left), (right, place + gram, place + gram + right <= sizes)):
        some = np.flatnonzero(fits)
        if len(some):
            half = gram_hashes(_runs_at(symbols, begin[some] + first[some], n), n)[::n] if n else np.zeros(len(some), np.uint64)
            order = np.lexsort((half, keys[some]))
            same = (keys[some][order][1:] == keys[some][order][:-1]) & (half[order][1:] == half[order][:-1])
            agrees[some[order]] |= np.r_[same, False] | np.r_[False, same]
    return agrees


def _runs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents in runs of less than 2**24 symbols, for memory; a longer document makes a run of its own."""
    lo = 0
    for hi in range(1, len(starts) + 1):
        if hi == len(starts) or ends[hi] - starts[lo] >= 2**24:
            yield lo, hi
            lo = hi


def _hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, size, digest = memoryview(symbols.tobytes()), symbols.itemsize, xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)), np.uint64, len(starts))


def _firsts(records: np.ndarray, d: np.ndarray, t: np.ndarray, own: bool) -> np.ndarray:
    """Which of the sorted records come first among equal segments, or stand in the first document."""
    new = np.r_[True, (records["content"][1:] != records["content"][:-1]) | (records["minimizer"][1:] != records["minimizer"][:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    first = d == d[start]
    return first & (t == t[start]) & (records["at"] == records["at"][start]) if own else first


def _unpacked(payload: bytes):
    n_docs, n = np.frombuffer(payload, "<i8", 2)
    d, t = np.frombuffer(payload, "<i8", 2 * n_docs, 16).reshape(2, n_docs)
    records, at = np.empty(n, RECORD), 16 + 16 * int(n_docs)
    for name in RECORD.names:
        records[name] = np.frombuffer(payload, RECORD[name], n, at)
        at += RECORD[name].itemsize * int(n)
    return d[records["doc"]], t[records["doc"]], records


def _payloads(rows) -> pa.RecordBatch:
    buckets, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _documents(d: np.ndarray, t: np.ndarray, items: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Items of documents, packed into one payload for each bucket of documents."""
    if not len(d):
        return
    bucket = (d ^ t) % parts
    order = np.lexsort((t, d, bucket))
    d, t, items, bucket = d[order], t[order], items[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    rows = ((int(bucket[a]), b"".join((np.int64(b - a).tobytes(), d[a:b].tobytes(), t[a:b].tobytes(), items[a:b].tobytes()))) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    yield _payloads(rows)


def _by_document(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """One row per document with all its items, each once: (d, t, items as bytes)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, items = [], []
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                n = int(np.frombuffer(payload, "<i8", 1)[0])
                heads.append(np.frombuffer(payload, "<i8", 2 * n, 8).reshape(2, n))
                items.append(np.frombuffer(payload, np.uint8, -1, 8 + 16 * n).reshape(n, -1))
        if not heads:
            return
        (d, t), items = np.concatenate(heads, axis=1), np.concatenate(items)
        size = items.shape[1]
        numbers = np.zeros((len(items), 8), np.uint8)  # items have at most 8 bytes
        numbers[:, :size] = items
        numbers = numbers.view("<u8")[:, 0]
        order = np.lexsort((numbers, t, d))
        same = (d[order[1:]] == d[order[:-1]]) & (t[order[1:]] == t[order[:-1]]) & (numbers[order[1:]] == numbers[order[:-1]])
        order = order[np.r_[True, ~same]]
        d, t, data = d[order], t[order], items[order].tobytes()
        cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]), True])
        for at in range(0, len(cuts) - 1, 10_000):
            some = cuts[at : at + 10_001]
            payloads = [data[a * size : b * size] for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d[some[:-1]]), pa.array(t[some[:-1]]), pa.array(payloads, pa.binary())], ["d", "t", name])

    return rows.repartition(parts, "bucket").mapInArrow(merge, f"d long, t long, {name} binary")


def _blocks(keys: np.ndarray, sizes: np.ndarray, most: int = 1_000_000) -> Iterator[slice]:
    """Sorted keys in blocks of about ``most`` symbols that part no key."""
    if not len(keys):
        return
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    lo = 0
    for a, b in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
        if total[b] - total[lo] > most and a > lo:
            yield slice(int(lo), int(a))
            lo = a
    yield slice(int(lo), len(keys))


def covered(flags: bytes | None, spans: bytes | None) -> list[tuple[int, int]]:
    """Maximal covered stretches of a document, in order."""
    flag = np.frombuffer(flags or b"", FLAG)
    flag = flag[flag["kind"] == GONE]
    span = np.frombuffer(spans or b"", SPAN)
    starts = np.r_[flag["at"].astype(np.int64), span["start"].astype(np.int64)]
    ends = np.r_[flag["at"].astype(np.int64) + flag["n"], span["end"].astype(np.int64)]
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[opens].tolist(), reach[np.r_[opens[1:] - 1, len(reach) - 1]].tolist(), strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, d, t, text): null ids last, null texts empty, a hash to tell texts with one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
