"""The running report, in tables and in streams, against counting all pairs."""

import json
import math
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from codewarden.operators import pairs, running
from codewarden.streaming import report

SCHEMA = "idx long, label int, pred int, skip boolean, score double"


def rows_of(seed, n, scores=7, start=0):
    r = random.Random(seed)
    out = []
    for i in range(start, start + n):
        # A third of all rows share one score.
        score = 0.5 if r.random() < 0.33 else r.randrange(scores) / scores
        out.append((i, r.randrange(2), int(score > 0.4), r.random() < 0.1, score))
    return out


def brute(rows, every):
    """rows_read -> (skipped, accuracy, precision, recall, f1, area) by going over all pairs."""
    out = {}
    for end in range(every, len(rows) + 1, every):
        seen = [x for x in sorted(rows)[:end] if not x[3]]
        tp = sum(x[1] and x[2] for x in seen)
        fp, fn = sum(not x[1] and x[2] for x in seen), sum(x[1] and not x[2] for x in seen)
        pos, neg = [x[4] for x in seen if x[1]], [x[4] for x in seen if not x[1]]
        won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        ratio = lambda a, b: a / b if b else 0.0
        p, q = ratio(tp, tp + fp), ratio(tp, tp + fn)
        area = won / (len(pos) * len(neg)) if pos and neg else None
        right = len(seen) - fp - fn
        out[end] = (end - len(seen), ratio(right, len(seen)), p, q, ratio(2 * p * q, p + q), area)
    return out


def got_of(df):
    names = ["rows_skipped", *running.MEASURES, "roc_auc"]
    return {r["rows_read"]: tuple(r[n] for n in names) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for at, line in want.items():
        assert got[at] == pytest.approx(line, nan_ok=True), at


@pytest.mark.parametrize("every,rows_per_range", [(10, 10**6), (10, 40), (1, 25), (3, 7), (100, 30)])
def test_report_equals_all_pairs(spark, every, rows_per_range):
    rows = rows_of(every, 400)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    got = running.running_report(
        df, every=every, skipped="skip", score="score", rows_per_range=rows_per_range
    )
    same(got_of(got), brute(rows, every))


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_blocks_do_not_change_the_gains(block, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", block)
    r = random.Random(block)
    rows = sorted((r.randrange(9) / 9, r.randrange(64), r.randrange(3), r.randrange(3)) for _ in range(200))
    rows = list({(s, d): (s, d, p, n) for s, d, p, n in rows}.values())
    import numpy as np

    walk, out = pairs._Walk(0), []
    columns = [np.array(x) for x in zip(*rows)]
    for a in range(0, len(rows), block):
        out += walk.gains(*[c[a : a + block] for c in columns]).tolist()
    for (s, d, p, n), gain in zip(rows, out):
        earlier = [x for x in rows if x[1] < d]
        low = sum(x[3] * ((x[0] < s) + (x[0] == s) / 2) for x in earlier)
        lost = sum(x[2] * ((x[0] < s) + (x[0] == s) / 2) for x in earlier)
        own = sum(x[3] * ((x[0] < s) + (x[0] == s) / 2) for x in rows if x[1] == d)
        assert gain == pytest.approx(p * (low + own) - n * lost)


def test_copies_of_a_row_grow_with_the_digits_only():
    assert [pairs.levels_of(n) for n in (0, 63, 64, 10**6, 10**9)] == [1, 1, 2, 4, 5]


def test_counts_brought_into_ranges_do_not_outnumber_the_rows(spark, monkeypatch):
    lines, carried = [], pairs._carried

    def counted(cut):
        out = carried(cut)
        lines.extend(out.groupBy("level").count().collect())
        return out

    monkeypatch.setattr(pairs, "_carried", counted)
    rows = rows_of(11, 6000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = running.running_report(df, every=2, skipped="skip", score="score", rows_per_range=20)
    assert got.filter("rows_read = 6000").count() == 1
    assert lines and max(n for _, n in lines) <= len(rows)


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows_of(3, 300), SCHEMA).mapInArrow(count, SCHEMA)
    running.running_report(df, every=10, skipped="skip", score="score", rows_per_range=40).collect()
    assert seen.value == 300


def write_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(("idx", "label", "pred", "skip", "score"), r))) for r in rows]
    (folder / name).write_text("\n".join(lines))


def run(spark, base, rows_per_range=10**6):
    stream = report.read_stream(spark, str(base / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
    report.running_stream(
        stream, str(base / "out"), str(base / "state"), str(base / "check"), every=10, skipped="skip",
        rows_per_range=rows_per_range,
    ).awaitTermination()
    return spark.read.parquet(str(base / "out"))


@pytest.mark.parametrize("rows_per_range", [10**6, 20])
def test_stream_gives_the_same_reports_and_goes_on(spark, tmp_path, rows_per_range):
    rows = rows_of(11, 137)
    # Batches that end within a step, and one that stays within one.
    write_file(tmp_path / "in", "a.json", rows[:44])
    run(spark, tmp_path, rows_per_range)
    write_file(tmp_path / "in", "b.json", rows[44:47])
    run(spark, tmp_path, rows_per_range)
    write_file(tmp_path / "in", "c.json", rows[47:])
    got = run(spark, tmp_path, rows_per_range)
    same(got_of(got), brute(rows, 10))
    kept = sorted(p.name for p in (tmp_path / "state" / "totals").iterdir() if p.name.startswith("batch"))
    assert kept == ["batch=1", "batch=2"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = rows_of(12, 60)
    held = report.RunningState(str(tmp_path / "state"))
    first, second = (spark.createDataFrame(x, SCHEMA) for x in (rows[:25], rows[25:]))
    for batch_id, batch in ((0, first), (0, first), (1, second), (1, second)):
        since = held.before(spark, batch_id)
        steps, seen = running.running_steps(batch, every=10, skipped="skip", score="score", since=since)
        last = steps.orderBy(F.desc("step")).first()
        totals = {c: last[f"all_{c}"] for c in running.COUNTS}
        scores = since.scores.unionByName(seen).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        held.after(spark, batch_id, running.Carried(totals, last["all_won"], scores))
    assert got_of(running.reports(steps, 10))[60] == pytest.approx(brute(rows, 10)[60])


@pytest.mark.parametrize("bad", [None, math.nan])
def test_a_missing_score_stops_the_stream(spark, tmp_path, bad):
    (tmp_path / "in").mkdir()
    line = {"idx": 1, "label": 1, "pred": 1, "skip": False, "score": 0.5}
    text = json.dumps(line | {"score": "NaN" if bad is not None else None})
    (tmp_path / "in" / "a.json").write_text(text)
    with pytest.raises(Exception, match="null or NaN"):
        run(spark, tmp_path)
    stream = report.read_stream(spark, str(tmp_path / "in"), "label int, score double").withColumnRenamed("score", "prob")
    with pytest.raises(Exception, match="null or NaN"):
        report.stream_report(stream, lambda df, i: df.collect(), str(tmp_path / "c2")).awaitTermination()


def test_a_batch_is_walked_once(spark, tmp_path, monkeypatch):
    rows = rows_of(13, 90)
    seen, walk = spark.sparkContext.accumulator(0), pairs._walk

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from walk([batch])

    monkeypatch.setattr(pairs, "_walk", counted)
    write_file(tmp_path / "in", "a.json", rows)
    same(got_of(run(spark, tmp_path)), brute(rows, 10))
    # One level of 9 steps: a row for each step and score.
    pairs_seen = {(i // 10, r[4]) for i, r in enumerate(sorted(rows)) if not r[3]}
    skipped = len({i // 10 for i, r in enumerate(sorted(rows)) if r[3]})
    assert len(pairs_seen) <= seen.value <= len(pairs_seen) + skipped


def test_a_walk_holds_no_counts_of_all_children_for_each_row():
    import numpy as np

    score = np.arange(4096) / 4096
    digit = np.arange(4096, dtype=np.int32) * 7 % 64
    walk = pairs._Walk(1)
    walk.gains(score[:9], digit[:9], digit[:9], digit[:9])
    tracemalloc.start()
    walk.gains(score, digit, digit + 1, digit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A table of 64 children is 2 MB.
    assert peak < 1.5e6
