"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is otherwise evaluated again for each array element, also when
    it was named in an earlier step: the optimizer may move its definition into the lambda, for
    instance with a filter it pushes down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def emit(df: DataFrame, rows: Column, keep: list[str], field: str) -> DataFrame:
    """The ``keep`` columns beside each struct of the array ``rows``; null and empty arrays vanish.

    ``field`` names a struct field that is never null. The test is made behind the generator, on
    what it emits: a filter on the array itself would be pushed down, and its costly expression
    evaluated once for the filter and again for the rows.
    """
    return df.select(*keep, F.inline_outer(rows)).filter(F.col(field).isNotNull())
