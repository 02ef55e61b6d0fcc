"""Weakness classes: counts, pruning, class ids and the rewritten target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.operators.clean import status_as_class
from codewarden.operators.ordered import ROWS_PER_RANGE, global_rank
from codewarden.support import small_side

# Fixed value: the order in which the splits are read when class ids are given out.
SPLIT_ORDER = ("train", "test", "valid")


def ignore_anti(df: DataFrame, ignored: DataFrame) -> DataFrame:
    """Rows whose class is not in ``ignored`` (one column, ``class``)."""
    return df.join(small_side(ignored.select("class").distinct()), "class", "left_anti")


def class_counts(classed: DataFrame) -> DataFrame:
    return classed.groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))


def class_stats(classed: DataFrame, order: str = "idx") -> DataFrame:
    """One row per class from one scan: count in each split, and where it was first seen."""
    rank = F.lit(len(SPLIT_ORDER))
    for i, split in reversed(list(enumerate(SPLIT_ORDER))):
        rank = F.when(F.col("split") == split, i).otherwise(rank)
    return classed.groupBy("class").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLIT_ORDER],
        F.min(F.struct(rank.alias("split_rank"), F.col(order).alias("at"))).alias("first_seen"),
    )


def _in_all(stats_row: Sequence[Column]) -> Column:
    return (stats_row[0] > 0) & (stats_row[1] > 0) & (stats_row[2] > 0)


def class_index(stats: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Class ids by first appearance, numbered in ranges where there are many classes."""
    seen = stats.select("class", "first_seen.split_rank", "first_seen.at")
    ranked = global_rank(seen, ["split_rank", "at"], "class_id", rows_per_range)
    return ranked.select("class", (F.col("class_id") - 1).cast("int").alias("class_id"))


def classes_of(classed: DataFrame, split: str) -> DataFrame:
    return classed.filter(F.col("split") == split).select("class").distinct()


def _seen_in(classed: DataFrame) -> DataFrame:
    """(class, train, test, valid): whether each split has the class, from one scan."""
    return classed.groupBy("class").agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in SPLIT_ORDER]
    )


def _all_splits() -> Column:
    return F.col("train") & F.col("test") & F.col("valid")


def common_classes(classed: DataFrame) -> DataFrame:
    return _seen_in(classed).filter(_all_splits()).select("class")


def all_classes(classed: DataFrame) -> DataFrame:
    return classed.filter(F.col("split").isin(*SPLIT_ORDER)).select("class").distinct()


def incomplete_classes(classed: DataFrame) -> DataFrame:
    seen = F.col("train") | F.col("test") | F.col("valid")
    return _seen_in(classed).filter(seen & ~_all_splits()).select("class")


def rare_classes(classed: DataFrame, min_count: int) -> DataFrame:
    """Classes of the train split with fewer than ``min_count`` rows there."""
    counts = classed.filter(F.col("split") == "train").groupBy("class").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.filter(F.col("n") < min_count).select("class")


def kept_class(
    ignored: Sequence[str] = (), complete: bool = False, min_count: int | None = None
) -> Column:
    """Whether a row of :func:`class_stats` survives the pruning."""
    keep = ~F.col("class").isin(list(ignored)) if ignored else F.lit(True)
    if min_count is not None:
        keep = keep & ((F.col("train") == 0) | (F.col("train") >= min_count))
    if complete:
        keep = keep & _in_all([F.col(s) for s in SPLIT_ORDER])
    return keep


def ignore_set(
    stats: DataFrame,
    ignored: Sequence[str] = (),
    complete: bool = False,
    min_count: int | None = None,
) -> DataFrame:
    """Classes to leave out: the given ones, the rare and, if asked, the incomplete."""
    pruned = stats.filter(~kept_class(ignored, complete, min_count)).select("class")
    given = stats.sparkSession.createDataFrame([(c,) for c in ignored], "class string")
    return pruned.union(given).distinct()


def class_lookup(df: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``class_id``; null where the class has none."""
    return df.join(small_side(index), "class", "left")


def to_multiclass(
    functions: DataFrame,
    ignored: Sequence[str] = (),
    complete: bool = False,
    min_count: int | None = None,
    order: str = "idx",
) -> tuple[DataFrame, DataFrame]:
    """Functions with their class id as target, and the class index.

    One scan counts the classes, a second rewrites the rows. Pruned classes drop out of the
    index, so the join on it is also the filter.
    """
    classed = status_as_class(functions)
    kept = class_stats(classed, order).filter(kept_class(ignored, complete, min_count))
    index = small_side(class_index(kept))
    rewritten = (
        classed.join(index, "class").withColumn("target", F.col("class_id")).drop("class_id")
    )
    return rewritten, index


def class_portions(df: DataFrame, label: str = "target") -> DataFrame:
    positive = F.avg((F.col(label) == 1).cast("double"))
    return df.agg(positive.alias("pos_portion"), (1.0 - positive).alias("neg_portion"))


def balance_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Add ``weight``: one over the share of the row's class, scaled to a sum of 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    every = W.partitionBy()  # two rows at most: one per label
    shares = counts.select(
        label, (1.0 / (F.col("__n") * F.count(F.lit(1)).over(every))).alias("weight")
    )
    return df.join(small_side(shares), label)
