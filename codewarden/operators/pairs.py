"""Pairs of rows that a growing input wins: what each step adds to the area under the ROC curve.

Steps are numbered, and their numbers read as digits of ``BITS`` bits, the widest digit first, make a
tree. Two rows of different steps meet in one node only: where their digits part first. A row is
therefore written once a level, ``levels`` times in all, and each node's rows are walked in the order of
their scores with a running count for each child: what stands in the counts of lesser children are
the rows of earlier steps with lower scores. No pair is ever formed.

Nodes of the lower levels are bounded by their steps. Those that may hold more rows than a range are
walked in ranges of the score, which begin with the counts that the ranges before them add up to; a
score that fills several ranges is cut by the step. All nodes share the cuts, so ranges are never so
short that the counts brought into them outnumber the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.operators.ordered import with_ranges

BITS = 6
CHILDREN = 1 << BITS
#: Rows that are counted at once.
BLOCK = 4096

NODE = ["level", "head"]
CELL = ["range", "part"]
#: Rows of kind 0 bring counts into a range; ``low_pos`` and ``low_neg`` are those below its first score.
WALKED = "step score pos neg kind digit low_pos low_neg".split()


def levels_of(last_step: int) -> int:
    """Digits that step numbers up to ``last_step`` have."""
    return max(1, -(-last_step.bit_length() // BITS))


class _Walk:
    """The running counts of one node, or of one range of it, in the order of (score, child)."""

    def __init__(self, level: int):
        self.level = level
        self.pos, self.neg = np.zeros(CHILDREN), np.zeros(CHILDREN)
        self.low_pos, self.low_neg = np.zeros(CHILDREN), np.zeros(CHILDREN)
        self.score: float | None = None

    def carry(self, digit, pos, neg, low_pos, low_neg) -> None:
        np.add.at(self.pos, digit, pos)
        np.add.at(self.neg, digit, neg)
        np.add.at(self.low_pos, digit, low_pos)
        np.add.at(self.low_neg, digit, low_neg)

    def gains(self, score, digit, pos, neg) -> np.ndarray:
        """For each row, pairs with earlier rows that its positives win, less those that its negatives
        don't lose; ties count half."""
        # Rows of one child with one score meet the same rows.
        first = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (digit[1:] != digit[:-1])])
        sizes = np.diff(np.r_[first, len(score)])
        score, digit = score[first], digit[first].astype(np.int16)
        fresh = np.diff(score, prepend=score[0] if self.score is None else self.score) != 0
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(score)), -1))
        gain = np.zeros(len(pos))
        for own, other, name, sign in ((pos, neg, "neg", 1), (neg, pos, "pos", -1)):
            counts = np.add.reduceat(other, first).astype(np.float64)
            held, low_held = getattr(self, name), getattr(self, f"low_{name}")
            lesser = _lesser(digit, counts) + (np.cumsum(held) - held)[digit]
            # What stands before a score's first row: less the lesser children of that score.
            before = np.cumsum(counts) - counts
            low = np.where(start >= 0, lesser - before + before[start], (np.cumsum(low_held) - low_held)[digit])
            gain += sign * own * np.repeat((low + lesser) / 2, sizes)
            if self.level == 0 and name == "neg":
                # Within a step each pair is seen from its positive row.
                gain += pos * np.repeat(_earlier(digit, counts) + held[digit] + counts / 2, sizes)
            if start[-1] >= 0:
                last = slice(0, start[-1])
                setattr(self, f"low_{name}", held + np.bincount(digit[last], counts[last], CHILDREN))
            setattr(self, name, held + np.bincount(digit, counts, CHILDREN))
        self.score = score[-1]
        return gain


def _earlier(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row, the sum of ``counts`` of the rows before it with the same key."""
    order = np.argsort(key, kind="stable")
    sorted_key, sums = key[order], np.cumsum(counts[order]) - counts[order]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    found = np.empty(len(key))
    found[order] = sums - np.repeat(sums[first], np.diff(np.r_[first, len(key)]))
    return found


def _lesser(digit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row, the sum of ``counts`` of the rows before it with a lesser digit. Two digits part first
    at one bit, where the lesser one has 0."""
    found = np.zeros(len(digit))
    for bit in range(BITS):
        zero = (digit >> bit & 1) == 0
        found += np.where(zero, 0, _earlier(digit >> (bit + 1), np.where(zero, counts, 0)))
    return found


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(step, gain) of batches that come sorted by node, range, kind, score and child."""
    key, walk = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in NODE + CELL])
        c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in WALKED}
        bounds = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (c["kind"][1:] != c["kind"][:-1])) + 1
        bounds = [0, *bounds.tolist(), len(keys)]
        steps, gains = [], []
        for first, last in zip(bounds, bounds[1:], strict=False):
            if key is None or (keys[first] != key).any():
                key, walk = keys[first], _Walk(int(keys[first][0]))
            if c["kind"][first] == 0:
                walk.carry(*[c[n][first:last] for n in ("digit", "pos", "neg", "low_pos", "low_neg")])
                continue
            for a in range(first, last, BLOCK):
                part = slice(a, min(a + BLOCK, last))
                gains.append(walk.gains(*[c[n][part] for n in ("score", "digit", "pos", "neg")]))
                steps.append(c["step"][part])
        if steps:
            step, where = np.unique(np.concatenate(steps), return_inverse=True)
            total = np.bincount(where, np.concatenate(gains))
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(total)], names=["step", "gain"])


def range_rows(most: int, rows_per_range: int) -> int:
    """Rows of a range where at most ``most`` rows are cut: ``rows_per_range``, or more.

    A level has at most ``most`` / range nodes that are wider than a range, each may meet every range,
    and brings a line for every child into it: from here on, no more lines than there are rows.
    """
    return max(rows_per_range, math.isqrt(CHILDREN * most))


def _carried(cut: DataFrame) -> DataFrame:
    """Rows that bring into each range of a node the counts of its children so far."""
    sums = cut.groupBy(*NODE, *CELL, "digit").agg(F.sum("pos").alias("at_pos"), F.sum("neg").alias("at_neg"))
    # Every child has a line in each range of its node: nodes that are cut are few.
    lines = cut.select(*NODE, *CELL).distinct()
    lines = lines.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))))
    filled = lines.join(sums, [*NODE, *CELL, "digit"], "left").fillna(0, ["at_pos", "at_neg"])
    child = W.partitionBy(*NODE, "digit")
    so_far = child.orderBy(*CELL).rowsBetween(W.unboundedPreceding, -1)
    below = child.orderBy("range").rangeBetween(W.unboundedPreceding, -1)
    return filled.select(
        *NODE,
        *CELL,
        "digit",
        F.coalesce(F.sum("at_pos").over(so_far), F.lit(0)).alias("pos"),
        F.coalesce(F.sum("at_neg").over(so_far), F.lit(0)).alias("neg"),
        F.coalesce(F.sum("at_pos").over(below), F.lit(0)).alias("low_pos"),
        F.coalesce(F.sum("at_neg").over(below), F.lit(0)).alias("low_neg"),
        F.lit(0).alias("kind"),
    )


def pair_gains(rows: DataFrame, size: int, last_step: int, every: int, rows_per_range: int) -> DataFrame:
    """(step, gain) of ``rows`` (step, score, pos, neg), one row a step and score, ``size`` in all and at
    most ``every`` a step: the pairs that a step's rows win against rows of steps up to it, but for
    the pairs of its negatives, of which those with lower or, by half, equal positives are taken off:
    all earlier positives times the step's negatives are to be added."""
    levels = levels_of(last_step)
    rows_per_range = range_rows(every * (last_step + 1), rows_per_range)
    rows, ranges = with_ranges(rows, ["score", "step"], rows_per_range, size)
    # Nodes of this level and above may hold more than a range.
    wide = next((n for n in range(levels) if every * CHILDREN ** (n + 1) > rows_per_range), levels)
    wide = wide if ranges else levels
    ranged = [F.col(c) for c in ranges] + [F.lit(0)] * (len(CELL) - len(ranges))
    level = F.col("level")
    shifted = lambda n: F.call_function("shiftright", F.col("step"), (n * BITS).cast("int"))
    staged = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    staged = staged.select(
        "level",
        shifted(level + 1).alias("head"),
        *[F.when(level >= wide, c).otherwise(0).alias(name) for c, name in zip(ranged, CELL, strict=True)],
        shifted(level).bitwiseAND(F.lit(CHILDREN - 1).cast("long")).cast("int").alias("digit"),
        *[F.col(c) for c in ("step", "score", "pos", "neg")],
        F.lit(1).alias("kind"),
        *[F.lit(0).cast("long").alias(c) for c in ("low_pos", "low_neg")],
    )
    if wide < levels:
        carried = _carried(staged.filter(level >= wide))
        carried = carried.withColumns({"step": F.lit(0).cast("long"), "score": F.lit(0.0)})
        staged = staged.unionByName(carried)
    return (
        staged.repartition(*NODE, *CELL)
        .sortWithinPartitions(*NODE, *CELL, "kind", "score", "digit")
        .mapInArrow(_walk, "step long, gain double")
        .groupBy("step")
        .agg(F.sum("gain").alias("gain"))
    )
