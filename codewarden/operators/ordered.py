"""Running totals and ranks over a total order that no single task has to hold.

The rows are written once; whatever a caller put into them is computed once. The written order is cut in ranges of similar size. Each range is totalled (a partial
aggregate that reads a few columns), the totals are summed up over the ranges, and every range
then starts from its carried total. Only the short table of range totals is ever ordered as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.support import materialize

# Rows one task may sort for a running total.
ROWS_PER_RANGE = 1_000_000
# Finest resolution of the quantiles. Beyond an eighth as many ranges their sizes vary more.
FINEST = 100_000
# Whole numbers up to this size are exact as doubles, so equality on a cut is reliable.
EXACT_DOUBLE = 2**53
# A string is cut by this many numbers of six bytes each; longer equal heads share a range.
HEADS = 3


def checked_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with order columns that stop the job at a missing or NaN value, whatever the size."""
    kinds = dict(df.dtypes)
    checks = {}
    for name in order:
        value = F.col(name)
        wrong = value.isNull()
        if kinds[name] in ("double", "float"):
            wrong = wrong | F.isnan(value)
        checks[name] = F.when(
            wrong, F.raise_error(F.lit(f"{name} is null or NaN"))
        ).otherwise(value)
    return df.withColumns(checks)


def _numbers(df: DataFrame, name: str) -> tuple[list[Column], bool]:
    """Numbers that order rows as column ``name`` does, and whether equal numbers mean equal
    values, so that the next order column may go on."""
    kind, value = dict(df.dtypes)[name], F.col(name)
    if kind == "string":
        raw = F.encode(value, "UTF-8")
        heads = [
            F.conv(F.rpad(F.hex(F.substring(raw, 6 * i + 1, 6)), 12, "0"), 16, 10).cast("double")
            for i in range(HEADS)
        ]
        return heads, False
    if kind == "date":
        return [F.unix_date(value).cast("double")], True
    if kind == "timestamp":
        return [F.unix_micros(value).cast("double")], True
    if kind == "boolean" or kind.startswith("decimal"):
        return [value.cast("double")], kind == "boolean"
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return [value.cast("double")], True
    raise TypeError(f"can't order by {name}: {kind}")


def _cuts(df: DataFrame, rows: int, rows_per_range: int) -> list[float]:
    """Boundaries that leave about ``rows_per_range`` of the ``rows`` rows between neighbours; a
    value that fills several ranges comes back several times."""
    ranges = math.ceil(rows / rows_per_range)
    if ranges <= 1:
        return []
    grid = [i / ranges for i in range(1, ranges)]
    return df.agg(F.percentile_approx("__value", grid, min(8 * ranges, FINEST))).first()[0]


def with_ranges(
    df: DataFrame,
    order: Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
    rows: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add range columns whose lexicographic order agrees with the order of ``order``.

    ``order`` names columns of numbers, strings, dates, times or booleans, sorted ascending; a
    missing or NaN value stops the job, and another type is refused, whatever the size. A value
    that fills several ranges alone gets a range of its own, which the next order column splits
    further, so ties do not pile up in one task. The cuts are literals of the plan: a recomputed
    task lands in the same ranges. No range columns are added when the data fits one range.
    ``df`` is read once for each level; ``rows`` is its size, counted if it isn't given.
    """
    df = checked_order(df, order)
    levels: list[Column] = []
    for name in order:
        numbers, whole = _numbers(df, name)
        levels += numbers
        if not whole:
            for other in order:
                _numbers(df, other)  # refuses types alike for any size
            break
    cells: list[str] = []
    tied: Column | None = None
    for depth, number_of in enumerate(levels):
        scope = df if tied is None else df.filter(tied)
        if tied is not None or rows is None:
            rows = scope.count()
        cuts = _cuts(scope.select(number_of.alias("__value")), rows, rows_per_range)
        if not cuts:
            break
        heavy = [c for c, times in Counter(cuts).items() if times >= 3 and abs(c) < EXACT_DOUBLE]
        splits = sorted(set(cuts) | {math.nextafter(c, math.inf) for c in heavy})
        cell, value = f"__range{depth}", f"__value{depth}"
        df = Bucketizer(
            splits=[-math.inf, *splits, math.inf], inputCol=value, outputCol=cell
        ).transform(df.withColumn(value, number_of))
        number = F.col(cell).cast("int")
        if tied is not None:
            number = F.when(tied, number).otherwise(0)
        df = df.withColumn(cell, number).drop(value)
        cells.append(cell)
        if not heavy:
            break
        here = number_of.isin(heavy)
        tied = here if tied is None else tied & here
    return df, cells


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    keys: Sequence[str] = (),
    cells: Sequence[str] | None = None,
    grand: Mapping[str, str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    most_rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums, within ``keys``, along ascending ``order``.

    ``order`` must be total within ``keys``. ``cells`` names range columns that are already there
    (for instance ``pos div 4096``); without it they are cut from the data. ``grand`` maps a name
    of ``totals`` to a column that receives its sum over all rows of the key. ``most_rows`` is a
    bound that the caller knows of the number of rows: what fits one range by it isn't written first.
    """
    grand = dict(grand or {})
    names = list(totals)
    hidden = {name: f"__sum_{name}" for name in names}
    kept = [c for c in df.columns if c not in (cells or ())] + names + list(grand.values())
    staged = checked_order(df, order).withColumns({hidden[n]: totals[n] for n in names})
    if most_rows is not None and most_rows <= rows_per_range:
        staged, cells = (staged if cells is None else staged.drop(*cells)), []
    else:
        staged = materialize(staged, "order")
    if cells is None:
        staged, cells = with_ranges(staged, order, rows_per_range)
    to_here = (W.unboundedPreceding, W.currentRow)

    if not cells:
        along = W.partitionBy(*keys).orderBy(*order).rowsBetween(*to_here)
        whole = W.partitionBy(*keys)
        out = staged.withColumns(
            {n: F.sum(hidden[n]).over(along) for n in names}
            | {g: F.sum(hidden[n]).over(whole) for n, g in grand.items()}
        )
        return out.select(*kept)

    per_cell = staged.groupBy(*keys, *cells).agg(
        *[F.sum(hidden[n]).alias(hidden[n]) for n in names]
    )
    before = W.partitionBy(*keys).orderBy(*cells).rowsBetween(W.unboundedPreceding, -1)
    carry = per_cell.select(
        *keys,
        *cells,
        *[F.sum(hidden[n]).over(before).alias(hidden[n]) for n in names],
        *[F.sum(hidden[n]).over(W.partitionBy(*keys)).alias(g) for n, g in grand.items()],
        F.lit(0).alias("__row"),
    )
    # One carried row leads each range, so a single shuffle by range serves the running sum.
    rows = staged.withColumn("__row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    along = W.partitionBy(*keys, *cells).orderBy("__row", *order).rowsBetween(*to_here)
    out = rows.withColumns(
        {n: F.sum(hidden[n]).over(along) for n in names}
        | {g: F.max(g).over(along) for g in grand.values()}
    )
    return out.filter("__row = 1").select(*kept)


def global_rank(
    df: DataFrame,
    order: Sequence[str],
    name: str = "rank",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """1-based position of each row in the total ascending order of ``order``."""
    return running_totals(
        df, order, {name: F.lit(1).cast("long")}, rows_per_range=rows_per_range
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    rows_per_group: int = ROWS_PER_RANGE,
) -> DataFrame:
    """1-based position within ``keys``, for groups of any size.

    Groups that fit a task are ranked by a plain window. Only if a count finds larger ones are
    those cut in ranges; they are at most rows / rows_per_group many.
    """
    df = materialize(checked_order(df, order), "groups")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if sizes.filter(F.col("__n") > rows_per_group).isEmpty():
        along = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(along).cast("long"))
    large = sizes.filter(F.col("__n") > rows_per_group).select(*keys)
    hot = df.join(large, list(keys), "left_semi")
    rest = df.join(large, list(keys), "left_anti")
    along = W.partitionBy(*keys).orderBy(*order)
    ranked = running_totals(
        hot, order, {name: F.lit(1).cast("long")}, keys=keys, rows_per_range=rows_per_group
    )
    return ranked.unionByName(
        rest.withColumn(name, F.row_number().over(along).cast("long"))
    )
