"""Runs of a job over one output folder: a run that is repeated takes the place of itself.

A run writes to a folder of its own and is then entered in the manifest, a table of one row for each
time a run was finished. Readers follow the manifest: they see the last finished folder of every run,
so neither a failed attempt nor a repeated one adds rows, and readers in between see a whole one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.support import remove

MANIFEST = "run string, folder string, at long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")


def commit_run(spark: SparkSession, path: str, run: str, write: Callable[[str], None]) -> str:
    """``write`` a run to a fresh folder under ``path`` and enter it as the content of ``run``."""
    folder = f"{path}/run-{uuid.uuid4().hex}"
    write(folder)
    entry = spark.createDataFrame([(run, folder.rsplit("/", 1)[1], time.time_ns())], MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return folder


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of every run: one row a run comes to the driver."""
    last = F.max(F.struct("at", "folder"))["folder"].alias("folder")
    rows = _manifest(spark, path).groupBy("run").agg(last).collect()
    return {row["run"]: f"{path}/{row['folder']}" for row in rows}


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Remove the folders whose run was finished again later; how many."""
    kept = set(committed(spark, path).values())
    every = [f"{path}/{row['folder']}" for row in _manifest(spark, path).select("folder").distinct().collect()]
    old = [folder for folder in every if folder not in kept]
    for folder in old:
        remove(spark, folder)
    return len(old)
