"""Evaluate a value once and use it inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column expression that a lambda mentions is evaluated again for every element; a lambda argument is not.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
