"""Benchmark decontamination by spaced-seed hashing.

A document leaks an item if ``WINDOW`` words in a row stand against ``WINDOW`` words of the item with
at most ``SUBSTITUTIONS`` of them different. Each mask of ``MASKS`` hashes some positions of a
stretch and ignores the others; whichever two words of a window differ, one mask fits in beside
them (a test goes through all cases), so equal hashes are found for every leak. Test and
training hashes are joined, and the words around each hit are compared.

Only training hashes that can be in the benchmark leave the scan: a bit table of the test hashes,
at most ``MOST_BITS`` bits whatever the benchmark's size, says which. A fuller table lets
more rows through to the join; it never loses one.

Words are lower-cased runs of letters, digits and bytes beyond ASCII. Items of ``LEAST_WORDS`` words up
to a window are looked for as a whole, without substitutions; shorter ones prove nothing and are
not looked for. Null and empty texts leak nothing. Rows with equal id and text are one document.
Repeated items count once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm import words
from codewarden.llm.common import all_columns, matching, row_key, written

WINDOW = 13
SUBSTITUTIONS = 2
#: Positions that count; what they leave out is ignored.
MASKS = (
    (0, 1, 3, 5, 6, 8, 9),
    (0, 3, 4, 5, 7, 9, 10),
    (0, 1, 2, 3, 6, 7, 10),
    (0, 2, 3, 7, 8, 9, 10),
)
LEAST_WORDS = 5
#: Bits of the table for each test hash, and in all.
BITS_EACH = 1024
MOST_BITS = 1 << 26
#: Words around a hit that any window over it can reach.
REACH = 2 * WINDOW - 1 - min(max(m) for m in MASKS)
#: What stands for positions outside a document and outside an item; they never match.
OUTSIDE = (0, 1)
#: Positions hashed in one go, so the arrays stay in the processor's cache.
STRIP = 1 << 16

PLACES = "mask int, hash long, at long, around array<long>"


def _places(hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...], outside: int, keep):
    """(mask, hash, text number, place in the text, words around) of all places that ``keep``
    wants. Whole short items have the mask number -length."""
    text_of_end = first[1:]
    shapes = [(n, list(m), n) for n, m in enumerate(MASKS)]
    shapes += [(-n, list(range(n)), 100 + n) for n in lengths]
    for mask, offsets, salt in shapes:
        span = max(offsets) + 1
        for begin in range(0, max(0, len(hashes) - span + 1), STRIP):
            strip = hashes[begin : begin + STRIP + span - 1]
            found = words.window_hashes(strip, offsets, salt)
            here = np.flatnonzero(keep(found))
            at = here + begin
            owner = np.searchsorted(text_of_end, at, "right")
            inside = at + span <= text_of_end[owner]
            here, at, owner = here[inside], at[inside], owner[inside]
            if not len(at):
                continue
            if mask >= 0:
                cells = at[:, None] + np.arange(REACH) - (WINDOW - span)
                known = (cells >= first[owner][:, None]) & (cells < text_of_end[owner][:, None])
                around = np.where(known, hashes[np.clip(cells, 0, len(hashes) - 1)], np.uint64(outside))
            else:
                around = np.zeros((len(at), 0), np.uint64)
            yield mask, found[here], owner, at - first[owner], around


def _batch(columns: list[pa.Array], names: list[str], places, lengths) -> Iterator[pa.RecordBatch]:
    for mask, found, owner, at, around in places:
        ends = np.arange(len(at) + 1, dtype=np.int32) * around.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                *[c.take(pa.array(owner)) for c in columns],
                pa.array(np.full(len(at), mask, np.int32)),
                pa.array(found.view(np.int64)),
                pa.array(at.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(around.ravel().view(np.int64))),
            ],
            names=[*names, "mask", "hash", "at", "around"],
        )


def index(benchmark: DataFrame) -> DataFrame:
    """All hashed places of the items (item_id, text), with ``class``: places that look alike in all that
    is compared are one class, whichever items they are in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first, _ = words.word_hashes(batch.column("text"), words.IS_GAP)
            counts = np.diff(first)
            short = sorted({int(n) for n in counts if LEAST_WORDS <= n < WINDOW})
            for part in _places(hashes, first, tuple(short), OUTSIDE[1], lambda h: np.ones(len(h), bool)):
                mask, found, owner, at, around = part
                # Long items are looked for by masks, short ones as a whole.
                fits = counts[owner] == -mask if mask < 0 else counts[owner] >= WINDOW
                part = (mask, found[fits], owner[fits], at[fits], around[fits])
                yield from _batch([batch.column("item_id")], ["item_id"], [part], short)

    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    places = items.mapInArrow(scan, f"item_id long, {PLACES}")
    return places.withColumn("class", F.xxhash64("mask", "hash", "around"))


def _filter_bits(places: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the hashes' first bits, as 64-bit words, and its size as a power of two. The
    size follows the number of hashes up to ``MOST_BITS``; executors join the bits of a word."""
    bits = int(min(max(BITS_EACH * places.count(), 1 << 16), MOST_BITS)).bit_length() - 1
    slots = places.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot"))
    one = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63).cast("long")).cast("int")
    )
    filled = slots.groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    # At most MOST_BITS / 64 rows, whatever the benchmark's size.
    for batch in filled.toArrow().to_batches():
        table[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return table, bits


SUMMARY = {"matched": F.max, "first_word": F.min, "last_word": F.max}


def _summary(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy("__id", "__text", "doc_id", by).agg(
        *[best(name).alias(name) for name, best in SUMMARY.items()]
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it leaks: key columns, ``doc_id``, ``item_id``, ``matched``
    (most equal words in a window), ``first_word`` and ``last_word`` (0-based, of the document).
    Items that share a passage have a row each."""
    items = written(index(benchmark).select("class", "item_id").distinct(), "items")
    return _summary(class_leaks(docs, benchmark).join(items, "class"), "item_id")


def class_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for each document and class of places, whichever items they are in."""
    test = written(index(benchmark).select("mask", "hash", "around", "class").distinct(), "benchmark")
    table, bits = _filter_bits(test)
    lengths = tuple(
        sorted(-r["mask"] for r in test.filter("mask < 0").select("mask").distinct().collect())
    )  # at most WINDOW - LEAST_WORDS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(found: np.ndarray) -> np.ndarray:
            slot = found >> np.uint64(64 - bits)
            word = table[(slot >> np.uint64(6)).astype(np.int64)]
            return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1

        for batch in words.strips(batches):
            hashes, first, _ = words.word_hashes(batch.column("text"), words.IS_GAP)
            keys = ["__id", "__text", "doc_id"]
            places = _places(hashes, first, lengths, OUTSIDE[0], known)
            yield from _batch([batch.column(k) for k in keys], keys, places, lengths)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["__id", "__text", "doc_id", "class"]
        for batch in batches:
            mask = batch.column("mask").to_numpy()
            for n in np.unique(mask):
                part = batch.filter(pa.array(mask == n))
                at = part.column("at").to_numpy()
                if n < 0:
                    best, start = np.full(len(at), -n), at
                    size = -int(n)
                else:
                    span, size = max(MASKS[n]) + 1, WINDOW
                    mine = part.column("around").flatten().to_numpy().reshape(-1, REACH)
                    test_ = part.column("item_around").flatten().to_numpy().reshape(-1, REACH)
                    # Positions outside the document or the item rule a window out.
                    gain = (mine == test_) - WINDOW * ((mine == OUTSIDE[0]) | (test_ == OUTSIDE[1]))
                    sums = np.cumsum(np.pad(gain, ((0, 0), (1, 0))), axis=1)
                    equal = sums[:, WINDOW : WINDOW + WINDOW - span + 1] - sums[:, : WINDOW - span + 1]
                    best, shift = equal.max(axis=1), equal.argmax(axis=1)
                    start = at - (WINDOW - span) + shift
                held = pa.array(best >= size - (SUBSTITUTIONS if n >= 0 else 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k) for k in keys],
                        pa.array(best.astype(np.int64)),
                        pa.array(start.astype(np.int64)),
                        pa.array((start + size - 1).astype(np.int64)),
                    ],
                    names=[*keys, "matched", "first_word", "last_word"],
                ).filter(held)

    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")
    ).withColumns(row_key())
    hits = rows.mapInArrow(scan, f"__id long, __text long, doc_id long, {PLACES}")
    hits = hits.join(test.withColumnRenamed("around", "item_around"), ["mask", "hash"])
    found = hits.mapInArrow(
        compare,
        "__id long, __text long, doc_id long, class long, matched long, first_word long, last_word long",
    )
    return _summary(found, "class")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, in all their columns."""
    bad = class_leaks(docs, benchmark).select("__id", "__text").distinct()
    return matching(docs, bad, "left_anti")[0].select(*all_columns(docs))
