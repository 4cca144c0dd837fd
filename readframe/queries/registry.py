"""Collects the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readframe.queries.inputs import oracle, table

def draw_sql(*parts: str) -> str:
    """Plain SQL of :func:`readframe.functions.draws.draw`."""
    return f"cast(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15)) as bigint)"


Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under its name, with the SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table_name: table(spark, sf_dir, table_name))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, recursive)
        return fn

    return register
