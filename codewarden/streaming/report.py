"""The quality report over a growing input, as a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codewarden.operators import running
from codewarden.operators.metrics import scores_from_counts
from codewarden.operators.ordered import ROWS_PER_RANGE
from codewarden.support import checked_score, materialize, remove


def report_of(counts: DataFrame) -> DataFrame:
    """One row of counts and measures from (label, pred, n)."""
    cells = {
        name: F.coalesce(F.sum(F.when((F.col("label") == t) & (F.col("pred") == p), F.col("n"))), F.lit(0))
        for name, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    }
    one = counts.agg(*[c.alias(name) for name, c in cells.items()])
    s = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return one.select(
        *cells, *[s[m].alias(m) for m in ("accuracy", "precision", "recall", "f1")]
    )


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_report(
    scored: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    threshold: float = 0.5,
) -> StreamingQuery:
    """Start the report over a stream of (label, prob); ``sink`` gets a report per batch.

    A null or NaN score stops the query.

    The state is one counter for each pair of label and prediction, whatever has been read. The
    query handles what is available and stops; started again with the same checkpoint it goes on
    from there.
    """
    counts = (
        scored.select(
            F.col("label").cast("int").alias("label"),
            (checked_score(F.col("prob"), "prob") > threshold).cast("int").alias("pred"),
        )
        .groupBy("label", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(report_of(batch).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A folder per batch, overwritten when the batch is repeated after a failure."""

    def sink(report: DataFrame, batch_id: int) -> None:
        report.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


SCORES = "score double, pos long, neg long"


class RunningState:
    """What the rows of all finished batches leave behind, as a folder per batch under ``path``.

    A batch that is repeated after a failure finds the state of the batch before it and writes its own
    once more. The scores are the distinct ones seen, with counts; folders that no repetition can
    need any more are removed.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self, part: str, batch_id: int) -> str:
        return f"{self.path}/{part}/batch={batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> running.Carried:
        if batch_id == 0:
            return running.Carried(scores=spark.createDataFrame([], SCORES))
        row = spark.read.parquet(self._folder("totals", batch_id - 1)).first().asDict()
        won = row.pop("won")
        scores = spark.read.schema(SCORES).parquet(self._folder("scores", batch_id - 1))
        return running.Carried(row, won, scores)

    def after(self, spark: SparkSession, batch_id: int, carried: running.Carried) -> None:
        kinds = ", ".join([f"{c} long" for c in running.COUNTS] + ["won double"])
        totals = [tuple(carried.totals[c] for c in running.COUNTS) + (carried.won,)]
        carried.scores.write.mode("overwrite").parquet(self._folder("scores", batch_id))
        spark.createDataFrame(totals, kinds).coalesce(1).write.mode("overwrite").parquet(
            self._folder("totals", batch_id)
        )
        for part in ("scores", "totals"):
            remove(spark, self._folder(part, batch_id - 2))


def running_stream(
    preds: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    order: str = "idx",
    every: int = 100,
    label: str = "label",
    pred: str = "pred",
    skipped: str | None = None,
    score: str = "score",
    rows_per_range: int = ROWS_PER_RANGE,
) -> StreamingQuery:
    """Start the report at every ``every``-th row of a stream, as :func:`running.running_report` gives it.

    Rows count in the order of their batches, within a batch in that of ``order``. A batch is ranked and
    counted like a table, in as many tasks as it needs; what it takes from before it are totals
    and the table of distinct scores. Reports go to ``out``, a folder per batch, which a repeated
    batch overwrites. The query handles what is available and stops; started again with the same
    folders it goes on where it was, within a step too. A null or NaN score stops it.
    """
    held = RunningState(state)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        since = held.before(spark, batch_id)
        # The batch's rows are written once by the running totals; nothing else reads the source.
        steps, seen = running.running_steps(
            batch, order, every, label, pred, skipped, score, rows_per_range, since
        )
        # A row a step, which the reports and the state are read from.
        steps = materialize(steps, "steps")
        running.reports(steps, every).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        # One row: the totals at the last step.
        last = steps.orderBy(F.col("step").desc()).first()
        carried = running.Carried(since.totals, since.won, since.scores)
        if last is not None:
            carried.totals = {c: int(last[f"all_{c}"]) for c in running.COUNTS}
            carried.won = float(last["all_won"])
            counts = since.scores.unionByName(seen).groupBy("score")
            carried.scores = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        held.after(spark, batch_id, carried)

    return (
        preds.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
