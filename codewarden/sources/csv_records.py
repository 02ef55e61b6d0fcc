"""CSV whose records span lines, read in as many tasks as the file has splits.

Where a record begins is known once the quotes before it are: a line break between an odd and an even
quote stands in a field. One pass counts, for each split, its quotes and the lines that begin a record
if the split begins outside of quotes, and if it begins inside. Sums over the splits of a file, a row
each, say in which state each split begins and how many records begin before it. A second pass then
puts the lines of each split together. A record that goes over a split's end is in pieces, few of them
a split; they are found by a pass of their own and put together by record number.

The first pass's sums hold for positions in the file, so another cut of the same file that starts
splits at other positions stops the job instead of giving other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.support import materialize, small_rows

RECORDS = "file string, number long, part long, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, value): every line with the split it is in; a split's lines come in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch cut where another split begins."""
    begin, file = batch.column("begin").to_numpy(), batch.column("file")
    same_file = pc.equal(file.slice(1), file.slice(0, max(len(file) - 1, 0))).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((begin[1:] != begin[:-1]) | ~same_file.astype(bool)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield file[a].as_py(), int(begin[a]), batch.slice(a, b - a)


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of splits; a split that goes over several batches has several rows."""
    for batch in batches:
        rows = []
        for file, begin, part in _runs(batch) if batch.num_rows else ():
            quotes = _quotes(part.column("value"))
            odd = (np.cumsum(quotes) - quotes) % 2
            rows.append((file, begin, int(quotes.sum()), int((odd == 0).sum()), int((odd == 1).sum())))
        if rows:
            kinds = [pa.string()] + [pa.int64()] * 4
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "begin", "quotes", "outside", "inside"])


def _split_states(lines: DataFrame) -> DataFrame:
    """(file, begin, odd, before): whether a split begins inside quotes, and the records before it."""
    parts = lines.mapInArrow(_count, "file string, begin long, quotes long, outside long, inside long")
    # Batches of a split come in order, and so do splits; a batch is a split's next stretch.
    parts = parts.withColumn("turn", F.monotonically_increasing_id())
    along = W.partitionBy("file").orderBy("begin", "turn").rowsBetween(W.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("quotes").over(along), F.lit(0)) % 2).alias("odd")
    entered = parts.select("file", "begin", "turn", odd, "outside", "inside")
    starts = F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))
    before = F.coalesce(F.sum(starts).over(along), F.lit(0)).alias("before")
    states = entered.select("file", "begin", "turn", "odd", before)
    first = F.min(F.struct("turn", "odd", "before")).alias("first")
    return states.groupBy("file", "begin").agg(first).select("file", "begin", "first.odd", "first.before")


class _Split:
    """The state of one split while its lines are put together."""

    def __init__(self, odd: int, before: int):
        self.odd, self.number = odd, before
        self.open: list[str] = []
        # Whether the open lines are of a record that began before this split.
        self.head = bool(odd)


def _assemble(whole: bool):
    """Whole records, or the pieces of those that go over a split's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, split = None, None
        out: list[tuple[str, int, int, str]] = []

        def close() -> None:
            # What is still open goes on in the next split.
            if split is not None and split.open and not whole:
                out.append((key[0], split.number, key[1], "\n".join(split.open)))

        for batch in batches:
            for file, begin, part in _runs(batch) if batch.num_rows else ():
                if key != (file, begin):
                    close()
                    key = (file, begin)
                    odd = part.column("odd")[0].as_py()
                    if odd is None:
                        raise RuntimeError(f"{file} was cut in other splits while it was read")
                    split = _Split(odd, part.column("before")[0].as_py())
                quotes = _quotes(part.column("value"))
                after = (np.cumsum(quotes) + split.odd) % 2
                ends = np.flatnonzero(after == 0)
                lines, at = part.column("value").to_pylist(), 0
                for end in ends.tolist():
                    if not split.open and not split.head:
                        split.number += 1
                    split.open += lines[at : end + 1]
                    if whole != split.head:
                        out.append((file, split.number, begin, "\n".join(split.open)))
                    split.open, split.head, at = [], False, end + 1
                if at < len(lines):
                    if not split.open and not split.head:
                        split.number += 1
                    split.open += lines[at:]
                split.odd = int(after[-1])
            if out:
                yield _records(out)
                out.clear()
        close()
        if out:
            yield _records(out)

    return run


def _records(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "number", "part", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): the records of CSV files, numbered from 1 within each, as they are spelled.

    Quotes are doubled within quoted fields, and stand nowhere else in a field. Lines end with a line
    feed, or with one behind a carriage return; line breaks in fields stay as they are. A record has to fit in memory, a file doesn't.
    """
    lines = _lines(spark, path)
    # One row a split, written once.
    states = materialize(_split_states(lines), "csv-splits")
    few = small_rows(states)
    if few is not None:
        known = F.broadcast(spark.createDataFrame(few, states.schema))
        marked = lines.join(known, ["file", "begin"], "left")
    else:
        # More splits than are broadcast: lines meet their state in a shuffle and are put in order again.
        turned = lines.withColumn("turn", F.monotonically_increasing_id()).join(states, ["file", "begin"], "left")
        marked = turned.repartition("file", "begin").sortWithinPartitions("file", "begin", "turn")
    marked = marked.select("file", "begin", "value", "odd", "before")
    whole = marked.mapInArrow(_assemble(True), RECORDS).select("file", "number", "record")
    pieces = marked.mapInArrow(_assemble(False), RECORDS)
    parts = F.array_sort(F.collect_list(F.struct("part", "record")))
    joined = F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")
    records = whole.unionByName(pieces.groupBy("file", "number").agg(joined))
    # The carriage return of the record's last line.
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
