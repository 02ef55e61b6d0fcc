import gzip
import io
import json
import tarfile
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from codewarden.operators import scoring
from codewarden.sources import readers, writers
from codewarden.streaming import report

RECORD = {"code": "int f() {\n  return 1;\n}", "idx": 7, "cwe": "CWE-79", "target": 1, "status": "X"}


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps(RECORD) + "\n{broken\n")
    rows = readers.read_jsonl(spark, str(path)).cache().collect()
    assert sorted(r["code"] or "" for r in rows) == ["", RECORD["code"]]
    assert [r[readers.CORRUPT] for r in rows if r["code"] is None] == ["{broken"]


def test_extra_flag(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({**RECORD, "skip": True}) + "\n")
    schema = readers.with_flag(readers.FUNCTION_SCHEMA, "skip")
    assert readers.read_jsonl(spark, str(path), schema).first()["skip"] is True


def test_compressed_pairs(spark, tmp_path):
    record = {"idx": 1, "target": 0, "pair": {"vuln": {"tokens": ["a"]}, "patch": {"tokens": ["b", "c"]}}}
    path = tmp_path / "a.jsonl.gz"
    path.write_bytes(gzip.compress((json.dumps(record) + "\n").encode()))
    row = readers.read_jsonl_gz(spark, str(path)).first()
    assert row["pair"]["patch"]["tokens"] == ["b", "c"]


def archive(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as out:
        for name, lines in members:
            body = "".join(json.dumps(x) + "\n" for x in lines).encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    first = [{**RECORD, "idx": i} for i in range(3000)]
    (tmp_path / "one.tar.gz").write_bytes(
        archive([("d/train.jsonl", [RECORD]), ("d/test.jsonl", first), ("e/test.jsonl", [RECORD])])
    )
    (tmp_path / "two.tar.gz").write_bytes(archive([("valid.jsonl", [RECORD])]))
    (tmp_path / "note.txt").write_text("not an archive")
    got = readers.read_archive(spark, str(tmp_path)).collect()
    assert sorted(r["idx"] for r in got) == list(range(3000))  # the first matching member only
    assert got[0]["code"] == RECORD["code"]
    splits = readers.read_archive_splits(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in splits} == {"train": 1, "test": 3000, "valid": 1}


def test_csv_with_quotes_and_lines(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    rows = [(1, 'say "x",\nthen\n"y"', 1), (2, "plain", 0)]
    df = spark.createDataFrame(rows, "idx long, code string, target int")
    df.write.option("header", True).option("escape", '"').csv(path)
    assert sorted(map(tuple, readers.read_csv(spark, path, df.schema).collect())) == rows
    pd.DataFrame(rows, columns=["idx", "code", "target"]).to_csv(tmp_path / "p.csv", index=False)
    back = readers.read_csv(spark, str(tmp_path / "p.csv"), df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_rejects_are_appended(spark, tmp_path):
    path = str(tmp_path / "rejects")
    df = spark.createDataFrame([(1, "a")], "func_id long, code string")
    writers.write_rejects(df, path)
    writers.write_rejects(df, path)
    assert spark.read.json(path).count() == 2


def test_failing_rows_do_not_fail_their_batch(spark):
    def load():
        def score(rows):
            if (rows["x"] == 3).any():
                raise ValueError("three")
            return rows["x"] / 10.0

        return score

    df = spark.range(6).selectExpr("id AS idx", "id AS x").repartition(1)
    got = {r["idx"]: (r["prob"], r["error"]) for r in scoring.score_with(df, load, ["x"]).collect()}
    assert got[3] == (None, "three")
    assert got[5] == (0.5, None)
    counts = scoring.skip_count(scoring.score_with(df, load, ["x"])).first()
    assert (counts["scored"], counts["skipped"]) == (5, 1)


def test_a_scorer_sees_pieces_of_a_batch(spark):
    df = spark.range(3000, numPartitions=1).selectExpr("id AS idx", "repeat('x', 4096) AS code", "date'2024-01-02' AS day")
    got = scoring.score_with(df, lambda: lambda rows: [float(len(rows))] * len(rows), ["code"], ["idx", "day"])
    seen = got.agg({"prob": "max", "idx": "sum", "error": "count"}).first().asDict()
    assert seen["max(prob)"] <= 1024
    assert (seen["sum(idx)"], seen["count(error)"]) == (2999 * 1500, 0)


def test_baseline_learns_and_chooses(spark):
    rows = [
        (i, f"{'strcpy buffer' if i % 2 else 'safe copy'} word{i % 5}", i % 2, split)
        for split in ("train", "valid", "test")
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "idx long, code string, target int, split string")
    got = scoring.train_baseline(df, (0.0, 0.1), features=256, max_iter=5, weight=None).collect()
    assert [r["chosen"] for r in sorted(got, key=lambda r: r["epoch"])] == [True, False]
    assert all(r["valid_auc"] == 1.0 for r in got)
    assert [r["test_auc"] for r in got if r["chosen"]] == [1.0]


def test_baseline_unpacks_little_of_a_batch_at_once():
    rows, words = 8000, 500
    buckets = pa.ListArray.from_arrays(
        pa.array(range(0, rows * words + 1, words), pa.int32()), pa.array([w % 300 + 1000 for w in range(rows * words)], pa.int32())
    )
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["train"] * rows), pa.array([1] * rows), pa.array([1.0] * rows), buckets],
        names=["split", "label", "weight", "buckets"],
    )
    tracemalloc.start()
    got = sum(part.num_rows for part in scoring._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == rows and peak < 40e6


def test_stream_report_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = T.StructType.fromDDL("label int, prob double")
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    seen = []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        stream = report.read_stream(spark, folder, schema)
        query = report.stream_report(stream, lambda df, i: seen.append(df.first()), check)
        query.awaitTermination()
        assert query.exception() is None

    run([(1, 0.9), (0, 0.9)])
    run([(1, 0.9), (0, 0.1)])
    assert [(r["tp"], r["fp"], r["tn"], r["fn"]) for r in seen] == [(1, 1, 0, 0), (2, 1, 1, 0)]
    assert seen[-1]["precision"] == pytest.approx(2 / 3)
    assert out


def test_a_repeated_run_takes_its_own_place(spark, tmp_path):
    from codewarden.sources import runs, writers

    path, schema = str(tmp_path / "rejects"), "func_id long, code string"
    frame = lambda *ids: spark.createDataFrame([(i, f"f{i}") for i in ids], schema)
    writers.write_rejects(frame(1, 2), path, "monday")
    writers.write_rejects(frame(3), path, "tuesday")
    writers.write_rejects(frame(1, 2), path, "monday")
    read = lambda: sorted((r["run"], r["func_id"]) for r in writers.read_rejects(spark, path, schema).collect())
    assert read() == [("monday", 1), ("monday", 2), ("tuesday", 3)]
    # An attempt that fails half way is not seen.
    with pytest.raises(ZeroDivisionError):
        runs.commit_run(spark, path, "tuesday", lambda folder: (frame(9).write.json(folder), 1 / 0))
    assert read() == [("monday", 1), ("monday", 2), ("tuesday", 3)]
    assert runs.drop_superseded(spark, path) == 1
    assert read() == [("monday", 1), ("monday", 2), ("tuesday", 3)]
    # Any sink, with its own reader.
    preds = spark.createDataFrame([(1, 0.5)], "idx long, prob double")
    out = str(tmp_path / "preds")
    for _ in range(2):
        runs.commit_run(spark, out, "r", lambda folder: writers.write_predictions(preds, folder))
    (folder,) = runs.committed(spark, out).values()
    assert [tuple(r) for r in writers.read_predictions(spark, folder).collect()] == [(1, 0.5)]
