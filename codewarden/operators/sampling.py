"""Seeded order, limits, and class-balanced draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.operators.ordered import ROWS_PER_RANGE, global_rank, running_totals
from codewarden.support import materialize, small_side

# Fixed values of the hash that stands for a random permutation.
HASH_FACTOR = 2654435761
MIX_FACTOR = 1597334677
SEED_FACTOR = 40503
HASH_RANGE = 2**32
ID_RANGE = 2**31
# Bits of the sum of scaled weights; draws have 60.
WEIGHT_BITS = 58


def shuffle_key(idx: Column, seed: Column | int = 0) -> Column:
    """Pseudo-random key in [0, 2**32) from id and seed; equal in every engine and every run.

    The seed is mixed in between two multiplications: added at the end, it would only turn the
    same order round. No product leaves the range of a long.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    spread = F.pmod(
        F.pmod(idx.cast("long"), F.lit(ID_RANGE)) * F.lit(HASH_FACTOR), F.lit(HASH_RANGE)
    )
    salt = F.pmod(seed.cast("long") * SEED_FACTOR, F.lit(HASH_RANGE))
    mixed = spread.bitwiseXOR(F.shiftright(spread, 15)).bitwiseXOR(salt)
    return F.pmod(mixed * F.lit(MIX_FACTOR), F.lit(HASH_RANGE))


def seeded_shuffle(
    df: DataFrame, seed: int = 0, key: str = "idx", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``shuffle_key`` and the row's ``position`` in the shuffled order, from 0."""
    keyed = df.withColumn("shuffle_key", shuffle_key(F.col(key), seed))
    ranked = global_rank(keyed, ["shuffle_key", key], "position", rows_per_range)
    return ranked.withColumn("position", F.col("position") - 1)


def limit_rows(df: DataFrame, n: int, key: str = "idx") -> DataFrame:
    """First ``n`` rows by key; one small heap per task, not a sort."""
    return df.orderBy(key).limit(n)


def preview(df: DataFrame, n: int = 3, key: str = "idx", tokens: str = "tokens") -> DataFrame:
    """First examples with the blank mark of their tokens made visible."""
    shown = F.transform(F.col(tokens), lambda t: F.replace(t, F.lit("Ġ"), F.lit("_")))
    return limit_rows(df, n, key).withColumn(tokens, shown)


def balanced_sample(
    df: DataFrame,
    n: int | None = None,
    seed: int = 0,
    label: str = "target",
    key: str = "idx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Draw ``n`` rows with replacement, every class being equally likely.

    Classes are numbered in their order, and rows within their class; each draw picks a class number
    and, by that class's size, a row number. Two equi-joins fetch them, the first with the table of
    classes, which is broadcast only if it is seen to be small. ``n`` defaults to the number of rows.
    Rows without a class are never drawn, and a table without classes gives no draws.
    """
    numbered = running_totals(
        df.filter(F.col(label).isNotNull()),
        [key],
        {"__number": F.lit(1).cast("long")},
        keys=[label],
        rows_per_range=rows_per_range,
    )
    # Read off the rows that the numbering has written.
    sizes = numbered.groupBy(label).agg(F.max("__number").alias("__size"))
    # Sizes are written once: draws and rows are to see the same numbers.
    classes = materialize(
        global_rank(sizes, [label], "__class", rows_per_range).select(
            (F.col("__class") - 1).alias("__pick"), label, "__size"
        ),
        "classes",
    )
    many, whole = classes.agg(F.count(F.lit(1)), F.sum("__size")).first()
    total = n if n is not None else whole or 0
    draw = F.col("id")
    draws = df.sparkSession.range(total if many else 0).select(
        draw.alias("draw"),
        F.pmod(shuffle_key(draw, 2 * seed), F.lit(max(many, 1))).cast("long").alias("__pick"),
        shuffle_key(draw, 2 * seed + 1).alias("__point"),
    )
    picked = draws.join(small_side(classes), "__pick").select(
        "draw", label, (F.pmod(F.col("__point"), F.col("__size")) + 1).alias("__number")
    )
    return picked.join(numbered, [label, "__number"]).drop("__number")


def _whole_weights(df: DataFrame, weight: str) -> Column:
    """The weights as whole numbers. Those of other types are multiplied by a power of two that takes their
    sum to ``WEIGHT_BITS`` bits, and rounded up, so each weight above 0 counts."""
    given = df.schema[weight].dataType
    number = F.col(weight) if isinstance(given, T.IntegralType) else F.col(weight).cast("double")
    wrong = (number < 0) | F.isnan(number) | (number == float("inf"))
    number = F.when(wrong, F.raise_error("weight is negative, NaN or infinite")).otherwise(number)
    if isinstance(given, T.IntegralType):
        return number.cast("long")

    def scaled(power: int) -> Column:
        # In two steps, as the power alone may be beyond a double.
        return number * F.lit(2.0 ** (power // 2)) * F.lit(2.0 ** (power - power // 2))

    most = df.agg(F.max(number)).first()[0]
    if not most:
        return F.lit(0).cast("long")
    # Whole numbers of 53 bits have the same sum in any order; a row loses less than 1 of it.
    power = 53 - math.frexp(most)[1]
    total, rows = df.agg(
        F.sum(F.floor(scaled(power)).cast("decimal(38,0)")), F.count(F.lit(1))
    ).first()
    return F.ceil(scaled(power + WEIGHT_BITS - (int(total) + rows).bit_length())).cast("long")


def weighted_sample(
    df: DataFrame,
    n: int,
    weight: str = "weight",
    seed: int = 0,
    key: str = "idx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Draw ``n`` rows with replacement by weights.

    Running weights place each row at a start; a draw is a point below the sum of all weights and
    takes the row whose weight it falls in. Starts and points are walked together in one order, so
    each draw learns the number of its row, and an equi-join on that number fetches it. Sums of
    whole numbers are the same in any order, and the walk is written once, so numbers agree.
    Fractional weights are scaled to whole numbers first; a row without weight, or with 0, is never
    drawn, and a negative, NaN or infinite weight is an error.
    """
    weighted = df.withColumn("__weight", _whole_weights(df, weight)).filter("__weight > 0")
    placed = materialize(
        running_totals(
            weighted.select(key, "__weight"),
            [key],
            {"__upto": F.col("__weight")},
            rows_per_range=rows_per_range,
        ),
        "weights",
    )
    whole = placed.agg(F.max("__upto")).first()[0]
    if whole is None:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    # 60 bits of two keys of the draw, so that any sum of weights is covered.
    high, low = shuffle_key(F.col("id"), 2 * seed), shuffle_key(F.col("id"), 2 * seed + 1)
    point = F.pmod(high * F.lit(2**28) + F.shiftright(low, 4), F.lit(whole))
    starts = placed.select(
        (F.col("__upto") - F.col("__weight")).alias("at"),
        F.lit(0).alias("kind"),
        F.col(key).alias("id"),
    )
    points = df.sparkSession.range(n).select(point.alias("at"), F.lit(1).alias("kind"), "id")
    walked = materialize(
        running_totals(
            starts.union(points),
            ["at", "kind", "id"],
            {"__number": (F.col("kind") == 0).cast("long")},
            rows_per_range=rows_per_range,
        ),
        "draws",
    )
    numbers = walked.filter("kind = 0").select(F.col("id").alias(key), "__number")
    draws = walked.filter("kind = 1").select(F.col("id").alias("draw"), "__number")
    return draws.join(numbers, "__number").drop("__number").join(df, key)
