"""Katz backoff over word pairs: Good-Turing discounted counts, with backoff weights that make every context sum to one.

The count table is partitioned by word, hot words by word and word before.  A task counts the pairs of many documents at a time,
and what a partition of the table gets from it are both its training counts and its questions, as packed arrays.  So a partition
knows all it needs for the tokens that were seen; tokens that back off ask for the weight of their context by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.llm.shared import cut, parts_of

#: Tokens and documents that a task counts at a time; documents fit in 16 bits.
FLUSH_TOKENS, FLUSH_DOCS = 2_500_000, 50_000
#: Tokens of one partition of the table, about.
PART_TOKENS = 3_000_000
#: A word with a larger share of all training tokens is spread; there are fewer such words than this.
HOT_WORDS = 1_000
#: Words with fewer tokens than this are never hot.
FREQUENT = 1_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
START, END = 0, 1  # numbers of the token before the first and of the last
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOC, SUM, CONTEXT, ASK, PAIR = range(5)
COUNTS = [f"m{r}" for r in range(1, DISCOUNTED + 2)]


def tokens(text: str | None) -> np.ndarray:
    """Numbers of the words, A-Z lower-cased, and the end."""
    words = (text or "").encode().translate(LOWER).split()  # on the six characters that separate words
    return np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(END))


def good_turing(n: list[int]) -> np.ndarray:
    """Factors of the counts 1 to 5, below one and above zero, from the numbers of entries counted once, twice, ... six times.

    Katz's factors; where they leave that range, as on few or odd counts, the leaving-one-out discount of each count.
    """
    r = np.arange(1, DISCOUNTED + 1)
    n = np.asarray(n, float)
    if n[: DISCOUNTED + 1].all():
        tail = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        factors = ((r + 1) * n[1:] / (r * n[:-1]) - tail) / (1 - tail) if tail != 1 else np.zeros(DISCOUNTED)
        if (factors > 0).all() and (factors < 1).all():
            return factors
    less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - less) / r


@dataclass(frozen=True)
class Words:
    """What is known of single words: bounded numbers, and the counts of the few hot ones."""

    tokens: int
    kinds: int
    all_tokens: int
    by_count: list[int]
    hot: np.ndarray
    hot_counts: np.ndarray

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of one word with each of the counts; all unknown words together have that of count 0."""
        factors = np.r_[0, good_turing(self.by_count), 1.0]
        free = float(sum(r * (1 - factors[r]) * self.by_count[r - 1] for r in range(1, DISCOUNTED + 1)))
        whole = self.tokens + (free == 0)
        return np.where(counts == 0, (free or 1) / whole, counts * factors[np.minimum(counts, DISCOUNTED + 1)] / whole)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed: most are small numbers in wide types."""
    plain = np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(payload: bytes, kinds: str) -> list[np.ndarray]:
    types = kinds.split()
    payload = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(payload, "<i8", len(types)), 8 * len(types), []
    for n, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(payload, f"<{kind}", n, at))
        at += out[-1].nbytes
    return out


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["part", "kind", "flush", "payload"])


SHIPPED = "part int, kind int, flush long, payload binary"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def count_words(docs: DataFrame) -> Words:
    """Statistics of single words over all training documents; ``docs`` has (held, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, n = [], 0, 0
        for batch in batches:
            for out, text in zip(batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = tokens(text)
                held += len(found) * out
                if not out:
                    kept.append(found)
                    n += len(found)
                if n >= FLUSH_TOKENS:
                    yield _counted(kept, held)
                    kept, held, n = [], 0, 0
        yield _counted(kept, held)

    def _counted(kept: list[np.ndarray], held: int) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept]), return_counts=True)
        # One row without a word carries the tokens that do not count.
        columns = [pa.array(np.r_[words.view(np.int64), 0], mask=np.r_[np.zeros(len(words), bool), True]), pa.array(np.r_[counts, held].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    words = docs.select("held", "text").mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Only frequent words keep their name; the others are told by how many there are of each count.
    name = F.when(F.col("n") >= FREQUENT, F.col("word"))
    kept = cut(words.groupBy(F.col("word").isNotNull().alias("known"), name.alias("word"), "n").agg(F.count("*").alias("kinds")))
    known, kinds = F.col("known"), F.col("kinds")
    by_count = [F.coalesce(F.sum(F.when(known & (F.col("n") == r), kinds)), F.lit(0)) for r in range(1, DISCOUNTED + 2)]
    row = kept.agg(F.sum(F.when(known, F.col("n") * kinds)), F.coalesce(F.sum(F.when(known, kinds)), F.lit(0)), F.sum(F.when(~known, F.col("n") * kinds)), *by_count).first()
    total = row[0] or 0
    hot = kept.where(known & F.col("word").isNotNull() & (F.col("n") > total / HOT_WORDS)).collect()
    numbers = np.array([r.word for r in hot], np.int64).view(np.uint64)
    order = np.argsort(numbers)
    return Words(total, row[1], total + (row[2] or 0), list(row[3:]), numbers[order], np.array([r.n for r in hot], np.int64)[order])


def _place(w: np.ndarray, h: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    mixed = w * MIX
    spread = mixed ^ ((h + np.uint64(1)) * MIX >> np.uint64(7))
    mixed = np.where(np.isin(w, hot), spread * MIX, mixed)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(parts)).astype(np.int32)


def _ship(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Pairs of each task's documents, packed for each partition of the table, and which documents they are."""
    kind = pa.int32() if docs.schema["doc_id"].dataType.simpleString() == "int" else pa.int64()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, helds, texts, n, flush = [], [], [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                ids.append(doc_id)
                helds.append(held)
                texts.append(tokens(text))
                n += len(texts[-1])
                if n >= FLUSH_TOKENS or len(ids) >= FLUSH_DOCS:
                    yield _batch(_flushed(ids, helds, texts, flush))
                    ids, helds, texts, n, flush = [], [], [], 0, flush + 1
        if ids:
            yield _batch(_flushed(ids, helds, texts, flush))

    def _flushed(ids, helds, texts, flush: int) -> list[tuple[int, int, int, bytes]]:
        lengths = np.array([len(t) for t in texts])
        w = np.concatenate(texts)
        texts.clear()
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)
        h = np.r_[np.uint64(START), w[:-1]]
        h[np.cumsum(lengths)[:-1]] = START
        part = _place(w, h, parts, hot)
        order = np.lexsort((doc, h, w, part))
        w, h, doc, part = w[order], h[order], doc[order], part[order]
        del order
        pair = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
        new = np.zeros(len(w), bool)
        new[pair] = True
        new |= np.r_[True, doc[1:] != doc[:-1]]
        entry = np.flatnonzero(new)
        times = np.diff(np.r_[entry, len(w)])
        train = np.add.reduceat((~np.array(helds, bool))[doc].astype(np.int64), pair)
        word = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (part[1:] != part[:-1])])
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        out = []
        at = [np.searchsorted(x, cuts) for x in (word, pair, entry)]
        for k in range(len(cuts) - 1):
            (a, b), (c, d), (e, f) = ((x[k], x[k + 1]) for x in at)
            stop = cuts[k + 1]
            pairs_of = np.diff(np.searchsorted(pair[c:d], np.r_[word[a:b], stop])).astype("<u4")
            entries_of = np.diff(np.searchsorted(entry[e:f], np.r_[pair[c:d], stop])).astype("<u4")
            payload = _pack(w[word[a:b]], pairs_of, h[pair[c:d]], train[c:d].astype("<u4"), entries_of, doc[entry[e:f]], times[e:f].astype("<u4"))
            out.append((int(part[cuts[k]]), SUM, flush, payload))
        info = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(helds, pa.bool_())], ["doc_id", "held"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, info.schema) as writer:
            writer.write_batch(info)
        return [*out, (flush % parts, DOC, flush, sink.getvalue().to_pybytes())]

    return docs.select("doc_id", "held", "text").mapInArrow(rows, SHIPPED)


ASKED = "u8 u4 u8 u4 u4 u2 u4"


def _answer(words: Words, with_pairs: bool):
    """One partition of the table: counts of its pairs, and what they give each document and context."""

    def rows(table: pa.Table) -> pa.Table:
        out, asked, flushes = [], [], []
        for part, kind, flush, payload in zip(*(table[c].to_pylist() for c in ("part", "kind", "flush", "payload")), strict=True):
            if kind == DOC:
                out.append((part, DOC, flush, payload))
            else:
                asked.append(_unpack(payload, ASKED))
                flushes.append(flush)
        if asked:
            out += _answered(asked, flushes, table["part"][0].as_py())
        return pa.Table.from_batches([_batch(out)])

    def _answered(asked, flushes, part: int):
        w = np.concatenate([np.repeat(a[0], a[1]) for a in asked])
        h, train = (np.concatenate([a[k] for a in asked]) for k in (2, 3))
        # Pairs of all flushes, each once, with their counts.
        order = np.lexsort((h, w))
        w, h = w[order], h[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (h[1:] != h[:-1])]
        first = np.flatnonzero(new)
        name = np.empty(len(w), np.int32)
        name[order] = np.cumsum(new, dtype=np.int32) - 1
        c2 = np.add.reduceat(train[order].astype(np.int64), first)
        w, h = w[first], h[first]
        del order, new, train
        opens = np.r_[True, w[1:] != w[:-1]]
        starts, of = np.flatnonzero(opens), np.cumsum(opens, dtype=np.int32) - 1
        c1, single = np.add.reduceat(c2, starts), w[starts]
        if len(words.hot):
            at = np.minimum(np.searchsorted(words.hot, single), len(words.hot) - 1)
            c1 = np.where(words.hot[at] == single, words.hot_counts[at], c1)
        probability = words.probability(c1)
        out = [(part, CONTEXT, 0, _contexts(h[c2 > 0], c2[c2 > 0], probability[of[c2 > 0]]))]
        if with_pairs:
            out.append((part, PAIR, 0, _pack(h, w, c2, c1[of])))
        # What a token of each pair adds to its document.
        follow = np.where((single != END) & (c1 > 0), np.log10(np.maximum(c1 + (c1 > DISCOUNTED), 1)), 0.0)
        base = words.base(c1)
        score = np.where(c2 == 0, np.log10(probability)[of], np.where(c2 > DISCOUNTED, np.log10(np.maximum(c2, 1)), 0.0)) - follow[of]
        at = 0
        for flush, (_, _, before, _, entries, doc, times) in zip(flushes, asked, strict=True):
            pair = np.repeat(name[at : at + len(before)], entries)
            at += len(before)
            docs, place = np.unique(doc, return_inverse=True)
            seen, word = c2[pair], of[pair]
            total = lambda weights: np.bincount(place, weights, len(docs))  # noqa: B023, E731
            numbers = [total(times), total(times * (c1[word] > 0)), *(total(times * (seen == r)) for r in range(1, DISCOUNTED + 1))]
            sums = [total(times * base[word]), total(times * score[pair])]
            out.append((part, SUM, flush, _pack(docs, *(x.astype("<u4") for x in numbers), *sums)))
            # Tokens that back off, by context.
            back = seen == 0
            out.append((part, ASK, flush, _pack(h[pair[back]], doc[back], times[back])))
        return out

    return rows


def _contexts(h: np.ndarray, c2: np.ndarray, probability: np.ndarray) -> bytes:
    """Per context here: its followers counted once, twice, ... six times, its tokens, and the followers' word probabilities."""
    known, place = np.unique(h, return_inverse=True)
    total = lambda weights: np.bincount(place, weights, len(known))
    return _pack(known, *(total(c2 == r).astype("<u4") for r in range(1, DISCOUNTED + 2)), total(c2).astype("<i8"), total(probability))


SUMS = "u2 " + "u4 " * (2 + DISCOUNTED) + "f8 f8"
NUMBERS = ["n_tokens", "n_known", *(f"c{r}" for r in range(1, DISCOUNTED + 1))]


def _documents(table: pa.Table) -> pa.Table:
    """One flush: its documents with their sums over all partitions of the table."""
    sums, info = [], None
    for kind, payload in zip(table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if kind == DOC:
            info = pa.ipc.open_stream(payload).read_all()
        else:
            sums.append(_unpack(payload, SUMS))
    place = np.concatenate([s[0] for s in sums])
    columns = [np.bincount(place, np.concatenate([s[k] for s in sums]), len(info)) for k in range(1, len(NUMBERS) + 3)]
    columns = [pa.array(c.astype(np.int64)) for c in columns[: len(NUMBERS)]] + [pa.array(c) for c in columns[len(NUMBERS) :]]
    where = [pa.array([table["flush"][0].as_py()] * len(info), pa.int64()), pa.array(np.arange(len(info)))]
    return pa.table([*where, *info.columns, *columns], ["flush", "doc", "doc_id", "held", *NUMBERS, "base", "part_score"])


def _unpacked(rows: DataFrame, kind: int, kinds: str, names: list[str], flush: bool = False) -> DataFrame:
    """Rows of packed arrays."""
    types = {"u8": ("long", np.int64), "u4": ("long", np.int64), "u2": ("long", np.int64), "i8": ("long", np.int64), "f8": ("double", np.float64)}
    schema = ", ".join(f"{n} {types[k][0]}" for n, k in zip(names, kinds.split(), strict=True)) + ", flush long" * flush

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, payload in zip(batch.column("flush").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                arrays = _unpack(payload, kinds)
                columns = [pa.array(a.view(np.int64) if k == "u8" else a.astype(types[k][1])) for a, k in zip(arrays, kinds.split(), strict=True)]
                if flush:
                    columns.append(pa.array(np.full(len(arrays[0]), mine, np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names + ["flush"] * flush)

    return rows.where(F.col("kind") == kind).select("flush", "payload").mapInArrow(open_, schema)


@dataclass(frozen=True)
class Model:
    """A trained model's tables, and the sums of the documents it was asked for."""

    words: Words
    factors: np.ndarray  # of pair counts 1 to 5
    contexts: DataFrame  # (h, tokens, weight): log10 of the backoff weight times the context's denominator
    answers: DataFrame
    id_type: str
    start: float  # log10 of the denominator of a document's first token

    def pairs(self) -> DataFrame:
        """(h, w, count, word_count, log10_probability) of all pairs seen in training, if they were kept."""
        found = _unpacked(self.answers, PAIR, "u8 u8 i8 i8", ["h", "w", "n", "word_n"]).where("n > 0")
        factor = reduce(lambda rest, r: F.when(F.col("n") == r, F.lit(float(self.factors[r - 1]))).otherwise(rest), range(1, DISCOUNTED + 1), F.lit(1.0))
        whole = self.contexts.select("h", (F.col("tokens") + (F.col("tokens") > DISCOUNTED).cast("long")).alias("whole"))
        return found.join(whole, "h").select("h", "w", "n", "word_n", F.log10(F.col("n") * factor / F.col("whole")).alias("log10_probability"))

    def weights(self) -> DataFrame:
        """(h, tokens, log10_weight) of all contexts: what an unseen follower's word probability is multiplied by."""
        return self.contexts.select("h", "tokens", (F.col("weight") - F.log10(F.col("tokens") + (F.col("tokens") > DISCOUNTED).cast("long"))).alias("log10_weight"))

    def scores(self) -> DataFrame:
        """(doc_id, held, n_tokens, n_known, base, score) of each document."""
        docs = self.answers.where(F.col("kind").isin(DOC, SUM)).select("flush", "kind", "payload")
        schema = f"flush long, doc long, doc_id {self.id_type}, held boolean, " + "".join(f"{n} long, " for n in NUMBERS) + "base double, part_score double"
        summed = docs.groupBy("flush").applyInArrow(_documents, schema)
        asked = _unpacked(self.answers, ASK, "u8 u2 u4", ["h", "doc", "times"], flush=True)
        # Under another name both sides are dealt out anew, so that the rows of a hot context can be split.
        name = F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("name")
        weights = self.contexts.select(name, "weight")
        backed = asked.select("flush", "doc", "times", name).join(weights, "name").groupBy("flush", "doc").agg(F.sum(F.col("times") * F.col("weight")).alias("backed"))
        seen = reduce(Column.__add__, [F.col(f"c{r}") * math.log10(r * self.factors[r - 1]) for r in range(1, DISCOUNTED + 1)])
        score = F.col("part_score") + seen + F.coalesce("backed", F.lit(0.0)) - F.lit(self.start)
        return summed.join(backed, ["flush", "doc"], "left").select("doc_id", "held", "n_tokens", "n_known", "base", score.alias("score"))


def _answers(docs: DataFrame, words: Words, parts: int, with_pairs: bool) -> DataFrame:
    # Documents in a fixed order, so that a task that runs again packs them alike.
    ordered = docs.select("doc_id", "held", "text", F.xxhash64("doc_id", "text").alias("key")).sortWithinPartitions("key")
    return _ship(ordered, parts, words.hot).groupBy("part").applyInArrow(_answer(words, with_pairs), SHIPPED)


def fit(docs: DataFrame, with_pairs: bool = False) -> Model:
    """Train on documents that are not held out and sum up all; ``docs`` has (doc_id, held, text).

    Both go over whole texts.  Pairs are only kept as a table ``with_pairs``.
    """
    words = count_words(docs)
    parts = max(parts_of(docs.sparkSession), -(-words.all_tokens // PART_TOKENS))
    answers = cut(_answers(docs, words, parts, with_pairs))
    names = ["h", *COUNTS, "tokens", "probability"]
    found = _unpacked(answers, CONTEXT, "u8 " + "u4 " * len(COUNTS) + "i8 f8", names)
    row = found.agg(*[F.sum(m) for m in COUNTS], F.sum(F.when(F.col("h") == START, F.col("tokens")))).first()
    factors = good_turing([n or 0 for n in row[: len(COUNTS)]])
    free = reduce(Column.__add__, [F.col(COUNTS[r - 1]) * float(r * (1 - factors[r - 1])) for r in range(1, DISCOUNTED + 1)])
    sums = found.select("h", "tokens", "probability", free.alias("free")).groupBy("h").agg(*[F.sum(n).alias(n) for n in ("tokens", "probability", "free")])
    free = F.col("free") + (F.col("tokens") > DISCOUNTED).cast("double")
    unknown = float(words.probability(np.array([0]))[0])
    weight = F.log10(free / F.greatest(1 - F.col("probability"), F.lit(unknown)))
    began = row[len(COUNTS)] or 0
    start = math.log10(began + (began > DISCOUNTED)) if began else 0.0
    contexts = sums.select("h", "tokens", weight.alias("weight"))
    return Model(words, factors, contexts, answers, docs.schema["doc_id"].dataType.simpleString(), start)


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """log10 probability of every document's tokens under a model of the documents that are not held out.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).  Tokens are words with A-Z in lower case, then
    one end.  Held out are documents whose doc_id, as text, has a crc32 with remainder ``fold``.  Words that no training
    document has share one probability.

    Null or blank text: only the end.  Null doc_id: a training document.  Repeated rows: each counts and is scored.  Further
    columns are ignored.  Without training documents every score is 0.  No rows: no rows.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held"), "text")
    model = fit(rows)
    total = F.lit(model.words.tokens).cast("long").alias("train_tokens")
    return model.scores().select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", total, F.col("base").alias("base_score"), "score")
