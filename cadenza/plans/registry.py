"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Floats as doubles of a few digits, so that the order of a sum does not show."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r(name: str, digits: int = 4) -> str:
    """The same in SQL."""
    return f"round(CAST({name} AS DOUBLE), {digits}) AS {name}"


def joined(c: Column | str, sep: str = ",") -> Column:
    """An array as text."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), sep)
