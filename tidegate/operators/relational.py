"""Operators written as SQL over named tables; Catalyst plans them like any DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def operator(sql: str, **defaults) -> Callable[..., DataFrame]:
    """A function of DataFrames, by the names in braces, and of `params`, the values of the :names; its text is kept as .sql."""

    def run(params: dict | None = None, **tables: DataFrame) -> DataFrame:
        unknown = (params or {}).keys() - defaults.keys()
        if unknown:
            raise TypeError(f"no such parameter: {sorted(unknown)}")
        spark = next(iter(tables.values())).sparkSession
        return spark.sql(sql, args=defaults | (params or {}), **tables)

    run.sql = sql
    return run
