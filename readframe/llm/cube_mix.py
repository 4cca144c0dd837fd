"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readframe.llm.shared import GAPS, cut, join_back

WEIGHTS = (5.0, 2.0, 1.0)
DOCS_PER_BLOCK = 4096
#: So many blocks' leftovers make one block of the next round.
MERGED = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(GAPS.replace("[", "[^", 1))), F.lit(0)).cast("long")


def shares(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: ``total`` times all sizes dealt by weight, none above ``most`` times its own size.

    Sources in order of their code points, null last, take the weights in turn.  What a source cannot take is dealt to
    the others by weight, until none is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, list(names), total * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move probabilities in place to 0 or 1 until at most two are left between, keeping sum(p) and sum(p * size).

    Three open documents span a plane through which exactly one direction leaves both sums as they are; a random step
    along it, with mean zero, brings at least one of them to 0 or 1, and the next document takes its place.
    """
    open_ = [k for k in range(len(p)) if 1e-9 < p[k] < 1 - 1e-9][::-1]
    draws = rng.random(len(open_) + 8)
    held: list[int] = []
    values, sizes = p.tolist(), size.tolist()
    for draw in draws:
        while len(held) < 3 and open_:
            held.append(open_.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - values[k]) / s if s > 0 else values[k] / -s for k, s in zip(held, u, strict=True) if s)
        down = min(values[k] / s if s > 0 else (1 - values[k]) / -s for k, s in zip(held, u, strict=True) if s)
        step = up if draw * (up + down) < down else -down
        for k, s in zip(held, u, strict=True):
            values[k] += step * s
            if values[k] < 1e-9 or values[k] > 1 - 1e-9:
                values[k] = float(round(values[k]))
        held = [k for k in held if 0 < values[k] < 1]
    p[:] = values


UNIT = "doc_id long, source_no long, size long, whole long, p double, draw long, blocks long, block long"


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["draw", "doc_id", "size"], kind="stable")
    p = group["p"].to_numpy().copy()
    flight(p, group["size"].to_numpy().astype(float), np.random.default_rng(int(group["draw"].iloc[0]) & (2**63 - 1)))
    return group.assign(p=p)


def fly(units: DataFrame, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """The same units with their probabilities moved to 0 or 1 by source, but for at most two units of a source.

    A source's units fly in blocks, so that no source meets in one task.  Each block leaves at most two open; these fly
    again, merged over many blocks, until one block of a source is left.
    """
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    blocks = units.where(open_).groupBy("source_no").agg(F.ceil(F.count("*") / docs_per_block).alias("blocks"))
    done = units.where(~open_).select("doc_id", "source_no", "size", "whole", "p")
    flying = join_back(units.where(open_), blocks, "source_no").withColumn("block", F.pmod(F.xxhash64("draw"), F.col("blocks")))
    while True:
        # One name for source and block: by two columns Spark would leave a source where a join has put it, in one task.
        cell = F.concat_ws(":", "source_no", "block").alias("cell")
        flown = cut(flying.select(*(c.split()[0] for c in UNIT.split(", "))).groupBy(cell).applyInPandas(_fly, UNIT))
        again = open_ & (F.col("blocks") > 1)
        done = done.union(flown.where(~again).select("doc_id", "source_no", "size", "whole", "p"))
        flying = flown.where(again)
        if flying.isEmpty():
            return done
        flying = flying.withColumn("block", F.floor(F.col("block") / MERGED)).withColumn("blocks", F.ceil(F.col("blocks") / MERGED))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = 1.5,
    most: float = 2.0,
    docs_per_block: int = DOCS_PER_BLOCK,
    max_sources: int = 100_000,
) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, size, source, source_size, target, taken).

    Each document is taken as often as its source's ratio of target to size says: its whole part for sure, its fraction
    by a balanced sample that keeps the numbers of words and documents of the source.  The last one or two open documents
    of a source are taken in part, so that the words of each source meet its target up to rounding.  Draws hash the
    documents, so reruns agree.

    Null or empty text: size 0, taken 0.  Null source: a source of its own, last in order.  Null doc_id: taken like any
    other.  Repeated rows: each is a document.  Further columns are ignored.  No rows: no rows.  The table of sources
    (name, size) is worked out on the driver; more than ``max_sources`` raise an error.
    """
    return _mixed(_sized(docs, F.col("doc_id")), weights, total, most, docs_per_block, max_sources)


def _sized(docs: DataFrame, name: Column) -> DataFrame:
    return docs.select(name.alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("draw"))


def _mixed(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = 1.5,
    most: float = 2.0,
    docs_per_block: int = DOCS_PER_BLOCK,
    max_sources: int = 100_000,
) -> DataFrame:
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()}
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    targets = shares(sizes, weights, total, most)
    rows = [(k, s, sizes[s], float(targets[s]), min(most, targets[s] / sizes[s]) if sizes[s] else 0.0) for k, s in enumerate(targets)]
    named = sized.sparkSession.createDataFrame(rows, "source_no long, name string, source_size long, target double, ratio double")
    units = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source_no", "size", "draw", F.col("ratio"))
    whole = F.floor(F.col("ratio") + 1e-9)
    part = F.greatest(F.lit(0.0), F.col("ratio") - whole)
    units = units.select("doc_id", "source_no", "size", "draw", whole.alias("whole"), F.when(F.col("size") == 0, F.lit(0.0)).when(part < 1e-9, F.lit(0.0)).otherwise(part).alias("p"))
    taken = F.col("whole") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    return fly(units, docs_per_block).join(named, "source_no").select("doc_id", "size", F.col("name").alias("source"), "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with their own columns: whole copies, and for documents taken in part their first words.

    A document taken one and a half times gives two rows with its doc_id, the second cut behind its share of the words.
    """
    # Documents go by a hash of all their columns; rows equal in all of them share what each of them is taken for.
    name = F.xxhash64(*docs.columns)
    amounts = _mixed(_sized(docs, name), **how).where("taken > 0").groupBy("doc_id", "source", "size", "taken").agg(F.count("*").alias("n"))
    share = amounts.groupBy("doc_id", "source", "size").agg(F.collect_list(F.struct("taken", "n")).alias("_amounts"))
    share = share.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_amounts")
    single = docs.withColumn("_name", name).withColumn("_n", word_count(F.col("text"))).dropDuplicates(["_name", "source", "_n"])
    joined = single.join(share, (F.col("_name") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")))
    joined = joined.withColumn("_amount", F.explode("_amounts")).withColumn("_taken", F.explode(F.array_repeat(F.col("_amount.taken"), F.col("_amount.n").cast("int"))))
    copies = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_n"))), lambda k: F.least(F.col("_n"), F.col("_taken") - k * F.col("_n"))))
    cut_text = F.array_join(F.slice(F.filter(F.split("text", GAPS), lambda w: w != ""), F.lit(1), F.col("_words").cast("int")), " ")
    out = joined.withColumn("_words", copies).withColumn("text", F.when(F.col("_words") == F.col("_n"), F.col("text")).otherwise(cut_text))
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
