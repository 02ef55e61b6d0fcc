"""Small helpers shared by the operators: shared scratch space and size-checked sides."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows and bytes that are ever pulled to the driver to become a broadcast side.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000
# Bytes of an Arrow batch that are unpacked in Python at once.
UNPACKED_BYTES = 1 << 22


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can see.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session,
    where driver and executors are one process, may fall back to a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="codewarden-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, purpose: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the number of rows, read off the footers of what was written."""
    back = materialize(df, purpose)
    return back, back.count()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, wherever it is stored."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small source, spread over all tasks before costly work on each row.

    A source that is read in at least as many partitions as there are task slots is left as it
    is: at scale this adds no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def small_rows(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> list | None:
    """The rows of ``df`` if it was seen to hold at most ``max_rows`` rows and, spelled as text,
    ``max_bytes`` bytes; otherwise None. Rows and bytes are counted on the executors first."""
    few = df.limit(max_rows + 1)
    spelled = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = few.agg(F.count(F.lit(1)).alias("n"), F.sum(spelled).alias("bytes")).first()
    if seen["n"] > max_rows or (seen["bytes"] or 0) > max_bytes:
        return None
    return df.limit(max_rows).collect()


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if, and only if, it was seen to be small in rows and in bytes.

    Meant for aggregates that are small by nature (classes, labels, vocabularies). The check
    reads at most ``max_rows + 1`` rows, so it stays bounded whatever ``df`` is. A larger ``df``
    is returned as it is, for a shuffled join with skew handling by adaptive execution.
    """
    rows = small_rows(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def pieces(batch: pa.RecordBatch | pa.Array, most: int = UNPACKED_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """An Arrow batch in slices of at most ``most`` bytes, or of one larger row."""
    rows = len(batch)
    if rows <= 1 or batch.nbytes <= most:
        yield batch
    else:
        yield from pieces(batch.slice(0, rows // 2), most)
        yield from pieces(batch.slice(rows // 2), most)


def checked_score(col: Column, what: str = "score") -> Column:
    """``col`` as double; a missing or NaN value stops the job instead of sorting somewhere."""
    value = col.cast("double")
    return F.when(
        value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{what} is null or NaN"))
    ).otherwise(value)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def truncated(value: Column) -> Column:
    """Integer part of a non-negative number, as Python's int()."""
    return F.floor(value).cast("long")
