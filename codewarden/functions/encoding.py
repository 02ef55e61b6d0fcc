"""Fixed-length id arrays and their masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.binding import bind


def _padded(ids: Column, length: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(ids))))


def truncate(tokens: Column, length: int) -> Column:
    """First ``length - 1`` entries of an array that has ``length`` or more."""
    return F.when(F.size(tokens) >= length, F.slice(tokens, 1, length - 1)).otherwise(tokens)


def encode_fixed(ids: Column, length: int, first: int, last: int, pad: int) -> Column:
    """Start id, at most ``length - 2`` ids, end id, padded on the right."""
    body = F.slice(ids, 1, length - 2)
    return _padded(F.concat(F.array(F.lit(first)), body, F.array(F.lit(last))), length, pad)


def encode_single(ids: Column, length: int, pad: int) -> Column:
    """Padded or cut to ``length``, the last id always being padding."""
    return _padded(F.slice(ids, 1, length - 1), length, pad)


def single_mask(ids: Column, length: int) -> Column:
    """Mask that goes with :func:`encode_single`."""
    used = F.least(F.size(ids), F.lit(length - 1))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def reference_ids(length: Column, first: int, ref: int, last: int) -> Column:
    """Baseline sequence: start id, ``length - 2`` reference ids, end id."""
    return F.concat(
        F.array(F.lit(first)), F.array_repeat(F.lit(ref), length - 2), F.array(F.lit(last))
    )


def segment_ends(ids: Column, sep: int) -> Column:
    """Positions just before each separator that follows another token."""

    def ends(known: Column) -> Column:
        return F.filter(
            F.transform(
                known,
                lambda x, i: F.when(
                    (i > 0) & (x == sep) & (F.get(known, i - 1) != sep), i - 1
                ),
            ),
            lambda i: i.isNotNull(),
        )

    return bind(ids, ends)


def segments(ids: Column, separators: list[int]) -> Column:
    """[first, last) ranges of tokens between separators; a run left open at the end is dropped.

    The ranges stand for the block-diagonal attention mask, whose cells are never laid out.
    """

    def closed(known: Column) -> Column:
        def marks(is_edge) -> Column:
            return F.filter(
                F.transform(known, lambda x, i: F.when(is_edge(x, i), i)), lambda i: i.isNotNull()
            )

        firsts = marks(
            lambda x, i: ~x.isin(separators) & ((i == 0) | F.get(known, i - 1).isin(separators))
        )
        lasts = marks(
            lambda x, i: x.isin(separators) & (i > 0) & ~F.get(known, i - 1).isin(separators)
        )
        # An open run at the end has a first position but no last one.
        return F.filter(
            F.zip_with(
                firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))
            ),
            lambda r: r["last"].isNotNull(),
        )

    return bind(ids, closed)


def mask_cells(ranges: Column) -> Column:
    """Number of ones the block-diagonal mask of the ranges would hold."""
    return F.aggregate(
        ranges,
        F.lit(0).cast("long"),
        lambda acc, r: acc + ((r["last"] - r["first"]) * (r["last"] - r["first"])).cast("long"),
    )
