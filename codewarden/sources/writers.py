"""Sinks: predictions, metrics, rewritten splits, class index, logits and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.operators.clean import align_predictions
from codewarden.sources.runs import commit_run, committed

SPLIT_NAMES = ("train", "valid", "test")


def write_predictions(preds: DataFrame, path: str) -> None:
    """``idx<TAB>prob`` text."""
    preds.select("idx", "prob").write.option("sep", "\t").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx long, prob double").option("sep", "\t").csv(path)


def write_class_predictions(preds: DataFrame, path: str) -> None:
    """``idx<TAB>[p0, p1, ...]`` text."""
    listed = F.concat(
        F.lit("["), F.array_join(F.transform("probs", lambda p: p.cast("string")), ", "), F.lit("]")
    )
    preds.select(F.concat_ws("\t", F.col("idx").cast("string"), listed)).write.text(path)


def read_class_predictions(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(
        parts[0].cast("long").alias("idx"), F.from_json(parts[1], "array<double>").alias("probs")
    )


def write_metrics_json(report: DataFrame, path: str) -> None:
    report.write.json(path)


def write_split_jsonl(functions: DataFrame, path: str) -> None:
    """JSON lines in one folder per split; all other fields are kept."""
    functions.write.partitionBy("split").json(path)


def split_paths(path: str) -> dict[str, str]:
    return {split: f"{path}/split={split}" for split in SPLIT_NAMES}


def write_class_index(index: DataFrame, path: str) -> None:
    index.select("class", "class_id").write.parquet(path)


def read_class_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("class string, class_id int").parquet(path)


def write_raw_preds(functions: DataFrame, preds: DataFrame, path: str) -> None:
    """The test records with their prediction as one more column, as CSV; a record without
    its prediction, or a prediction without its record, stops the job."""
    joined = align_predictions(functions, preds.select("idx", F.col("pred").alias("raw_preds")))
    joined.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_logits(scored: DataFrame, path: str) -> None:
    """(idx, logits array<double>) as Parquet."""
    scored.select("idx", "logits").write.parquet(path)


def write_rejects(rejects: DataFrame, path: str, run: str | None = None) -> None:
    """Functions whose flaw lines were not found, beside what is there. The same ``run`` written again
    takes the place of what it wrote before; read such runs with :func:`read_rejects`. Without a run's
    name rows are appended. Any other sink gets runs by :func:`commit_run`."""
    if run is None:
        rejects.write.mode("append").json(path)
    else:
        commit_run(rejects.sparkSession, path, run, rejects.write.json)


def read_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rejects of all runs, with the run's name."""
    whole = spark.createDataFrame([], f"{schema}, run string")
    for run, folder in committed(spark, path).items():
        whole = whole.unionByName(spark.read.schema(schema).json(folder).withColumn("run", F.lit(run)))
    return whole


def write_corpus(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
