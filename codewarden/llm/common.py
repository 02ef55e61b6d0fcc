"""What the operators of this folder share: tables, keys of rows, written stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.support import shared_dir

#: What stands for a missing id inside keys; it sorts before every id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Columns that tell documents apart and join without null handling. Rows that agree in id
    and text are one document: they get the same decision, and each of them stays a row."""
    return {
        "__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
        "__text": F.xxhash64(F.col(text)),
    }


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, behind as many underscores as it takes to be none of ``taken``, in any case."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = f"_{name}"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with its row key as one struct, and that column's name, which ``docs`` had not."""
    name = unused(docs.columns, "__key")
    return docs.withColumn(name, F.struct(*[c.alias(k) for k, c in row_key().items()])), name


def matching(docs: DataFrame, keys: DataFrame, how: str) -> tuple[DataFrame, str]:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) their key among ``keys``
    (__id, __text), still with their key, and its name."""
    rows, name = keyed(docs)
    return rows.join(keys.select(F.struct("__id", "__text").alias(name)), name, how), name


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it instead of computing it again,
    and a lost executor costs no more than the tasks it had."""
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str, folds: int) -> Column:
    """Which of ``folds`` parts a document is in, by its id alone; a missing id is in part 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))
