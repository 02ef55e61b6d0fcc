"""CSV read split by split gives the rows of Spark's own reader, which reads a file in one task."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from codewarden.sources import csv_records, readers

SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("note", T.StringType())]
)


def spelled(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([("code", "idx", "note"), *rows])
    return out.getvalue()


def some_rows(seed, n):
    r = random.Random(seed)
    bits = ["a", "b c", '"', '""', "\n", "\n\n", ",", "é", "\r\n", "x = 1;", "'", "", "日本"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(6)))
    return [(text(), i, text()) for i in range(n)]


def whole(spark, path):
    """Spark's reader, one task a file."""
    reader = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').csv(str(path))


@pytest.fixture
def cut(spark):
    """Sets the bytes of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def at(size):
        for name, value in zip(names, (size, 0, 1)):
            spark.conf.set(name, value)

    yield at
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_offset(spark, cut, tmp_path, end):
    # In a file whose lines end with both, Spark's reader shortens such ends within fields too; ours keeps them.
    rows = [('two\nlines "quoted", and', 1, "plain"), ("", 2, '"'), ("last\n\n", 3, "a\nb"), ("é\n", 4, "")]
    text = spelled(rows, end)
    (tmp_path / "a.csv").write_text(text, newline="")
    want = rows_of(whole(spark, tmp_path))
    assert len(want) == 4
    size = len(text.encode())
    for offset in [*range(1, size, 5), size, size + 1]:
        cut(offset)
        assert rows_of(readers.read_csv(spark, str(tmp_path), SCHEMA)) == want, offset


@pytest.mark.parametrize("seed,size", [(1, 7), (2, 40), (3, 1000), (4, 128_000_000)])
def test_random_files(spark, cut, tmp_path, seed, size):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(spelled(some_rows(seed + 10 * n, 60)), newline="")
    want = rows_of(whole(spark, tmp_path))
    cut(size)
    assert rows_of(readers.read_csv(spark, str(tmp_path), SCHEMA)) == want


def test_many_tasks_and_numbers_in_order(spark, cut, tmp_path):
    rows = [(f"f {i}\n\"{i}\"\n", i, "x") for i in range(300)]
    (tmp_path / "a.csv").write_text(spelled(rows), newline="")
    cut(500)
    records = csv_records.csv_records(spark, str(tmp_path))
    assert records.rdd.getNumPartitions() > 10
    got = sorted((r["number"], r["record"]) for r in records.collect())
    assert [n for n, _ in got] == list(range(1, 302))
    assert [next(csv.reader(io.StringIO(t)))[1] for _, t in got[1:]] == [str(i) for i in range(300)]


def test_more_splits_than_are_broadcast(spark, cut, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(spelled(some_rows(9, 80)), newline="")
    want = rows_of(whole(spark, tmp_path))
    cut(30)
    monkeypatch.setattr(csv_records, "small_rows", lambda df: None)
    assert rows_of(readers.read_csv(spark, str(tmp_path), SCHEMA)) == want


def test_open_quote_empty_lines_and_empty_files(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_text('code,idx,note\n\na,1,b\n\n"open,2\nto the end\n', newline="")
    (tmp_path / "b.csv").write_text("", newline="")
    (tmp_path / "c.csv").write_text("code,idx,note\n", newline="")
    got = {r["idx"]: r["code"] for r in readers.read_csv(spark, str(tmp_path), SCHEMA).collect()}
    assert got[1] == "a" and len(got) == 2
