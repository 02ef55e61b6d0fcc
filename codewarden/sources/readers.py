"""Readers of labelled functions: JSON lines, pair records, CSV and archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.sources.csv_records import csv_records

# How fields are quoted.
CSV = {"quote": '"', "escape": '"'}
CORRUPT = "_corrupt_record"

FUNCTION_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)
_TOKENS = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType()))])
PAIR_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("target", T.IntegerType()),
        T.StructField(
            "pair", T.StructType([T.StructField("vuln", _TOKENS), T.StructField("patch", _TOKENS)])
        ),
    ]
)


def with_flag(schema: T.StructType, flag: str | None) -> T.StructType:
    """The schema with one more boolean column, as named by the caller."""
    return schema if not flag else T.StructType([*schema.fields, T.StructField(flag, T.BooleanType())])


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: T.StructType = FUNCTION_SCHEMA
) -> DataFrame:
    """JSON lines by a declared schema; a line that does not parse is kept in its own column."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_jsonl_gz(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = PAIR_SCHEMA,
) -> DataFrame:
    """Compressed JSON lines. One file is one task, so the rows are spread out again after it."""
    return read_jsonl(spark, path, schema).hint("rebalance")


def read_splits(
    spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = FUNCTION_SCHEMA
) -> DataFrame:
    """Several files or folders as one frame with a ``split`` column."""
    frames = [
        read_jsonl(spark, path, schema).withColumn("split", F.lit(split))
        for split, path in paths.items()
    ]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; code may span lines, and quotes are doubled. Records are found in every
    split of a file by itself (:mod:`csv_records`), so one large file is read in many tasks."""
    records = csv_records(spark, path).filter("number > 1 AND record <> ''")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", fields, CSV)
    return records.select(parsed.alias("__record")).select("__record.*")


def archive_lines(
    archives: DataFrame, member: str | Sequence[str], batch: int = 1024
) -> DataFrame:
    """(path, member, line) of the first member of each archive whose name ends with ``member``,
    or with each of several names; one read of the archive serves them all.

    ``archives`` holds (path, content). An archive is one task; its lines leave in batches.
    """
    names = [member] if isinstance(member, str) else list(member)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                missing = list(names)
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for entry in archive:
                        name = next((n for n in missing if entry.name.endswith(n)), None)
                        if name is None or not entry.isfile():
                            continue
                        missing.remove(name)
                        lines: list[str] = []
                        for raw in archive.extractfile(entry):
                            line = raw.decode("utf-8").rstrip("\r\n")
                            if line:
                                lines.append(line)
                            if len(lines) == batch:
                                yield pd.DataFrame({"path": path, "member": name, "line": lines})
                                lines = []
                        if lines:
                            yield pd.DataFrame({"path": path, "member": name, "line": lines})
                        if not missing:
                            break

    return archives.select("path", "content").mapInPandas(
        run, "path string, member string, line string"
    )


def parse_lines(lines: DataFrame, schema: T.StructType = FUNCTION_SCHEMA) -> DataFrame:
    """JSON text in ``line`` to columns, with a corrupt-record column; other columns stay."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        "line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in lines.columns if c != "line"]
    return lines.withColumn("__record", parsed).select(*others, "__record.*")


def read_archive(
    spark: SparkSession,
    path: str,
    member: str = "test.jsonl",
    schema: T.StructType = FUNCTION_SCHEMA,
) -> DataFrame:
    """Labelled functions out of ``tar.gz`` archives in a folder, spread out after unpacking."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    # One archive a task: large ones must not queue behind each other.
    lines = archive_lines(archives.repartition("path"), member).drop("member")
    return parse_lines(lines.hint("rebalance"), schema)


def read_archive_splits(
    spark: SparkSession, path: str, schema: T.StructType = FUNCTION_SCHEMA
) -> DataFrame:
    """The train, valid and test members of archives, as one frame with a ``split`` column; each
    archive is read once."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    names = [f"{split}.jsonl" for split in ("train", "valid", "test")]
    lines = archive_lines(archives.repartition("path"), names)
    split = F.regexp_replace("member", r"\.jsonl$", "")
    return parse_lines(
        lines.select("path", split.alias("split"), "line").hint("rebalance"), schema
    )


def pack_archive(rows: pd.DataFrame, member_column: str = "member", line_column: str = "line") -> bytes:
    """One ``tar.gz`` of JSON-line members, as bytes; used where archives are made from tables."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for member, part in rows.groupby(member_column, sort=True):
            body = ("\n".join(part[line_column]) + "\n").encode("utf-8")
            info = tarfile.TarInfo(str(member))
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return buffer.getvalue()


def record_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
