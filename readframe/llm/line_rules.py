"""Quality rules from line frequency across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.llm.shared import GAP_CHARS, GAPS, words

WINDOW = 8


def text_measures(text: Column) -> dict[str, Column]:
    """Counts that need one text only; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = _lines_with_words(text)
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.translate(text, GAP_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)


def repeated_words(words_: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of ``size`` words that occur at least twice in the list.

    Window hashes are compared first; only where some are equal are windows sorted and compared word by word, and the
    covered stretches added up from left to right.
    """

    def windows(w):
        # Hashes of 1, 2, 4, ... words, each made of two of the former; get() gives null outside the list.
        def double(span):
            return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + span)))

        hashes, span = F.transform(w, lambda x: F.xxhash64(x)), 1
        while span < size:
            hashes, span = _bind(hashes, double(min(span, size - span))), min(2 * span, size)
        return F.slice(hashes, 1, F.size(w) - (size - 1))

    def covered(w, placed):
        def same(one, other):
            return F.coalesce((one["h"] == other["h"]) & (F.slice(w, one["i"] + 1, size) == F.slice(w, other["i"] + 1, size)), F.lit(False))

        # get() gives null outside the list.
        twins = F.filter(placed, lambda x, k: same(x, F.get(placed, k - 1)) | same(x, F.get(placed, k + 1)))
        return F.aggregate(
            F.array_sort(F.transform(twins, lambda x: x["i"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + size - F.greatest(a["end"], i)).alias("n"), (i + size).alias("end")),
            lambda a: a["n"],
        )

    def counted(w, hashes):
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_bind(placed, lambda p: covered(w, p)))

    none = F.lit(0).cast("long")
    return _bind(words_, lambda w: F.when(F.size(w) < size, none).otherwise(_bind(windows(w), lambda h: counted(w, h))))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value made once per row: inside a lambda an expression is made again at each use."""
    return F.transform(F.array(value), body)[0]


def line_words(text: Column) -> Column:
    """Hash and word count of each line that has a word.

    Lines count as equal if their words are, in lower case and with each digit taken as a zero.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "123456789", "000000000")
    split_lines = F.transform(F.split(plain, "\n"), words)
    return F.transform(F.filter(split_lines, lambda w: F.size(w) > 0), lambda w: F.struct(F.xxhash64(w).alias("h"), F.size(w).alias("n")))


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hash is in a list; lines without a word stay."""
    plain = F.translate(F.lower(text), "123456789", "000000000")
    hashes = F.transform(F.split(plain, "\n"), lambda x: _bind(words(x), lambda w: F.when(F.size(w) > 0, F.xxhash64(w))))

    def kept(known):
        return F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.array_contains(frequent, F.get(known, i)), F.lit(False)))

    return F.array_join(_bind(hashes, kept), "\n")


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """Each row as a whole, its host's name, and two hashes that stand for its text."""
    # A present host gets an h in front, so that none can look like the missing one.
    name = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("none"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text"), name.alias("host"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def frequent_lines(texts: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """Lines in more than ``min_docs`` and more than ``max_share`` of a host's distinct texts: (host, frequent hashes).

    At most mean lines per document / ``max_share`` lines of a host can be that frequent, so the list of a host is short
    whatever its size.
    """
    rows = texts.select("host", "t1", "t2", F.explode(F.array_distinct(F.transform(line_words(F.col("text")), lambda x: x["h"]))).alias("line_hash"))
    counts = rows.distinct().groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"))
    sizes = texts.select("host", "t1", "t2").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    many = counts.where(F.col("n_docs") > min_docs).join(sizes, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
    return many.groupBy("host").agg(F.collect_list("line_hash").alias("frequent"))


def judged(
    docs: DataFrame,
    kept_columns: list[str],
    host: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_docs: int = 20,
    max_share: float = 0.05,
    min_kept_percent: int = 30,
) -> DataFrame:
    """Measures and verdict of each row next to a struct ``row`` of the columns asked for; see :func:`line_quality`."""
    texts = _keyed(docs, host)
    measured = texts.select(
        F.struct(*(F.col("row")[c].alias(c) for c in kept_columns)).alias("row"), "host",
        *(c.alias(n) for n, c in text_measures(F.col("text")).items()),
        repeated_words(words(F.col("text"))).alias("n_repeat_words"),
        line_words(F.col("text")).alias("lines"),
    )
    gone = F.aggregate(F.filter("lines", lambda x: F.array_contains("frequent", x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (left < min_words) | (100 * left < min_kept_percent * F.col("n_words"))
    return (
        measured.join(frequent_lines(texts, min_docs, max_share), "host", "left")
        .withColumn("n_line_words", F.coalesce(gone, F.lit(0).cast("long")))
        .select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_line_words", (~failed & ~depleted).alias("kept"), "frequent")
    )


def line_quality(docs: DataFrame, **limits) -> DataFrame:
    """Verdict per document: base rules, then whether enough is left once lines frequent on its host are gone.

    Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, kept).  A
    document is rejected if it has fewer than ``min_words`` words, if more than ``max_repeat_percent`` of its words lie in
    repeated 8-word windows, or if after removal of frequent lines fewer than ``min_words`` words or less than
    ``min_kept_percent`` of its words stay.  A line is frequent if more than ``min_docs`` documents and more than
    ``max_share`` of the documents of its host have it; documents of equal text count once.

    Null or empty text: no words, so rejected.  Null host: a host of its own.  Null or repeated doc_id: every input row
    gives one row, judged by its own text.  Further columns are ignored.  No rows: no rows.
    """
    return judged(docs, ["doc_id"], **limits).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")


def keep_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, without the lines frequent on their host; see :func:`line_quality`.

    All their columns; ``n_chars``, if there is one, counts the characters of the new text.
    """
    kept = judged(docs, docs.columns, **limits).where("kept")
    changed = F.col("n_line_words") > 0
    text = F.when(changed, without_lines(F.col("row.text"), F.col("frequent"))).otherwise(F.col("row.text"))
    # The input's columns stay inside ``row``, so that none can clash with these.
    out = kept.select("row", changed.alias("changed"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
