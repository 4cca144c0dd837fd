"""Ratios over count columns, guarded against empty denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), which equals the harmonic mean of precision and recall."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation.  Counts become doubles before the product, which would overflow a long."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def with_scores(df, tp: str = "tp", fp: str = "fp", fn: str = "fn", prefix: str = "", digits: int | None = None):
    """Add precision, recall and f1 columns."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    scores = {"precision": precision(t, p), "recall": recall(t, n), "f1": f1(t, p, n)}
    if digits is not None:
        scores = {name: F.round(value, digits) for name, value in scores.items()}
    return df.withColumns({prefix + name: value for name, value in scores.items()})
