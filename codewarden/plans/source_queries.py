"""Registered queries: readers, sinks and the streaming report, as round trips of the given tables.

Files go to the folder the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewarden.operators import classes, lines, metrics, vocab
from codewarden.operators.heads import apply_head
from codewarden.plans import views
from codewarden.plans.class_queries import TO_MULTICLASS, multiclass
from codewarden.plans.line_queries import _located, _wanted
from codewarden.plans.metric_queries import _BINARY, running_events
from codewarden.plans.registry import ORACLE, query, round_doubles
from codewarden.plans.row_queries import FLAW_TEXT, PAIR_CODE, joined_flaws, pair_records, picked_code
from codewarden.plans.scoring_queries import _dot
from codewarden.plans.views import HEAD, sql
from codewarden.sources import readers, writers
from codewarden.streaming import report
from codewarden.support import shared_dir

# Parts, each a batch, that the running report is read from.
STREAM_PARTS = 4
FIELDS = ["code", "idx", "cwe", "target", "status"]


@query("read_jsonl", sql("SELECT code, idx, cwe, target, status FROM functions", "functions"))
def read_jsonl(spark, sf):
    path = shared_dir(spark, "jsonl")
    views.functions(spark, sf).select(*FIELDS).write.json(path)
    return readers.read_jsonl(spark, path).select(*FIELDS)


@query("read_jsonl_gz", PAIR_CODE)
def read_jsonl_gz(spark, sf):
    path = shared_dir(spark, "pairs")
    pair_records(spark, sf).write.option("compression", "gzip").json(path)
    return picked_code(readers.read_jsonl_gz(spark, path))


@query("read_splits", sql("SELECT split, code, idx, cwe, target, status FROM functions", "functions"))
def read_splits(spark, sf):
    path = shared_dir(spark, "splits")
    writers.write_split_jsonl(views.functions(spark, sf), path)
    return readers.read_splits(spark, writers.split_paths(path)).select("split", *FIELDS)


def _archives(spark, sf):
    """The functions as archives with a member per split; an archive holds one Arrow batch."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            name = f"part-{rows['idx'].min()}.tar.gz"
            yield pd.DataFrame({"path": [name], "content": [readers.pack_archive(rows)]})

    records = views.functions(spark, sf).select(
        "idx",
        F.concat(F.lit("data/"), "split", F.lit(".jsonl")).alias("member"),
        F.to_json(F.struct(*FIELDS)).alias("line"),
    )
    return records.mapInPandas(pack, "path string, content binary")


@query(
    "read_archive",
    sql("SELECT code, idx, cwe, target, status FROM functions WHERE split = 'test'", "functions"),
)
def read_archive(spark, sf):
    found = readers.archive_lines(_archives(spark, sf), "test.jsonl").drop("member")
    return readers.parse_lines(found).select(*FIELDS)


@query(
    "read_csv",
    sql(
        f"""SELECT doc_id AS idx, text AS code, CAST(doc_id % 2 AS INTEGER) AS target, flaws AS flaw_line
            FROM documents LEFT JOIN {FLAW_TEXT} ON doc_id = func_id""",
        "line_rows",
    ),
)
def read_csv(spark, sf):
    path = shared_dir(spark, "csv")
    docs = views.code(spark, sf).withColumn("target", (F.col("idx") % 2).cast("int"))
    flaws = joined_flaws(spark, sf).select(
        F.col("func_id").alias("idx"), F.col("flaws").alias("flaw_line")
    )
    table = docs.join(flaws, "idx").select("idx", "code", "target", "flaw_line")
    table.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return readers.read_csv(spark, path, table.schema)


@query(
    "write_predictions", sql("SELECT idx, round(prob, 6) AS prob FROM scores", "scores")
)
def write_predictions(spark, sf):
    path = shared_dir(spark, "predictions")
    writers.write_predictions(views.scores(spark, sf), path)
    return round_doubles(writers.read_predictions(spark, path))


@query(
    "write_class_predictions",
    sql(
        """SELECT idx, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2
           FROM class_probs""",
        "class_probs",
    ),
)
def write_class_predictions(spark, sf):
    path = shared_dir(spark, "class-predictions")
    writers.write_class_predictions(views.class_probs(spark, sf), path)
    probs = F.col("probs")
    back = writers.read_class_predictions(spark, path)
    return round_doubles(
        back.select("idx", *[probs[i].alias(f"p{i}") for i in range(3)])
    )


@query("write_metrics_json", sql(_BINARY, "curve"))
def write_metrics_json(spark, sf):
    path = shared_dir(spark, "metrics")
    measured = metrics.binary_report(views.scores(spark, sf))
    writers.write_metrics_json(measured, path)
    return round_doubles(spark.read.schema(measured.schema).json(path))


@query("write_split_jsonl", TO_MULTICLASS)
def write_split_jsonl(spark, sf):
    path = shared_dir(spark, "multiclass")
    rewritten, _ = multiclass(spark, sf)
    writers.write_split_jsonl(rewritten, path)
    schema = "idx long, class string, status string, target int"
    fields = T.StructType.fromDDL(schema)
    back = readers.read_splits(spark, writers.split_paths(path), fields)
    return back.select("idx", "split", "class", "status", "target")


@query(
    "write_class_index",
    sql(
        """SELECT class, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS class_id
           FROM (SELECT class, min(CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END
                   * 10000000000 + idx) AS first_seen FROM classed GROUP BY class)""",
        "classed",
    ),
)
def write_class_index(spark, sf):
    path = shared_dir(spark, "class-index")
    _, index = classes.to_multiclass(views.functions(spark, sf))
    writers.write_class_index(index, path)
    return writers.read_class_index(spark, path)


@query(
    "write_raw_preds",
    sql(
        """SELECT idx, code, target, CAST(prob > 0.5 AS INTEGER) AS raw_preds FROM predictions
           WHERE split = 'test'""",
        "predictions",
    ),
)
def write_raw_preds(spark, sf):
    path = shared_dir(spark, "raw-preds")
    test = views.functions(spark, sf).filter("split = 'test'").select("idx", "code", "target")
    preds = metrics.threshold_predict(
        views.predictions(spark, sf).filter("split = 'test'").select("idx", "prob")
    )
    writers.write_raw_preds(test, preds, path)
    schema = T.StructType.fromDDL("idx long, code string, target int, raw_preds int")
    return readers.read_csv(spark, path, schema)


@query(
    "write_logits",
    f"""SELECT vec_id AS idx, round({_dot('embedding', 7, 3)}, 6) AS z0,
          round({_dot('embedding', 5, 2)}, 6) AS z1 FROM embeddings""",
)
def write_logits(spark, sf):
    path = shared_dir(spark, "logits")
    scored = apply_head(views.table(spark, sf, "embeddings"), HEAD, vector="embedding")
    writers.write_logits(scored.withColumnRenamed("vec_id", "idx"), path)
    z = F.col("logits")
    back = spark.read.schema("idx long, logits array<double>").parquet(path)
    return round_doubles(back.select("idx", z[0].alias("z0"), z[1].alias("z1")))


@query(
    "write_rejects",
    _located(
        """SELECT doc_id AS func_id, coalesce(code, '') AS code FROM documents LEFT JOIN spelled ON doc_id = func_id
           WHERE doc_id NOT IN (SELECT func_id FROM verified)"""
    ),
)
def write_rejects(spark, sf):
    path = shared_dir(spark, "rejects")
    rejects = lines.localize(_wanted(spark, sf), (0.2,), (5,))[2]
    writers.write_rejects(rejects, path, "localize")
    return writers.read_rejects(spark, path, "func_id long, code string").drop("run")


@query(
    "write_corpus", sql("SELECT line FROM line_rows WHERE length(line) > 0", "line_rows")
)
def write_corpus(spark, sf):
    path = shared_dir(spark, "corpus")
    writers.write_corpus(vocab.corpus_lines(views.code(spark, sf)), path)
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line")


_STREAM_CELLS = """SELECT count_if(NOT label AND NOT pred) AS tn, count_if(NOT label AND pred) AS fp,
    count_if(label AND NOT pred) AS fn, count_if(label AND pred) AS tp
  FROM (SELECT event_type = 'error' AS label, (event_id % 100) / 100.0 > 0.5 AS pred FROM events)"""


@query(
    "stream_report",
    f"""SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
          CAST(tp AS BIGINT) AS tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
          round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
          round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_STREAM_CELLS})""",
)
def stream_report(spark, sf):
    base = shared_dir(spark, "stream")
    events = views.table(spark, sf, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("event_id") % 100 / 100.0).alias("prob"),
    )
    # Several files, so that the stream runs over several batches.
    events.repartition(4).write.json(f"{base}/in")
    stream = report.read_stream(spark, f"{base}/in", events.schema, files_per_batch=2)
    running = report.stream_report(
        stream, report.parquet_sink(f"{base}/out"), f"{base}/checkpoint"
    )
    running.awaitTermination()
    last = running.lastProgress
    latest = last["batchId"] if last["numInputRows"] else _last_batch(running)
    one = spark.read.parquet(f"{base}/out/batch={latest}")
    return round_doubles(one.drop("batch"))


@query("stream_running_report", ORACLE["running_report"])
def stream_running_report(spark, sf):
    """The report at every 100th event, over events that come in parts, one after the other."""
    base = shared_dir(spark, "stream")
    events = running_events(spark, sf)
    bounds = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = (bounds[1] - bounds[0]) // STREAM_PARTS + 1
    for n in range(STREAM_PARTS):
        # A part is any number of files. The stream takes what has come as a batch, and goes on with the next part.
        first = bounds[0] + n * width
        some = events.filter((F.col("event_id") >= first) & (F.col("event_id") < first + width))
        some.write.mode("append").json(f"{base}/in")
        stream = report.read_stream(spark, f"{base}/in", events.schema)
        report.running_stream(
            stream, f"{base}/out", f"{base}/state", f"{base}/checkpoint", order="event_id", skipped="skip"
        ).awaitTermination()
    return round_doubles(spark.read.parquet(f"{base}/out").drop("batch"))


def _last_batch(running) -> int:
    """Number of the last batch that read rows."""
    return max(p["batchId"] for p in running.recentProgress if p["numInputRows"])


