"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Digits that results with fractions are rounded to before they are compared.
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(col: Column | str, digits: int = DIGITS) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )
