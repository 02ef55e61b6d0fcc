"""Missing, NaN and repeated values get the same answer whatever the size of the data."""

import math

import pytest
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.operators import classes, clean, lines, metrics, scoring
from codewarden.operators.ordered import global_rank, with_ranges
from codewarden.sources import writers

FORMS = [2, 1_000_000]


def stops(df):
    with pytest.raises(Exception, match="null or NaN|no partner|several rows"):
        df.collect()


@pytest.mark.parametrize("rows", FORMS)
@pytest.mark.parametrize("bad", [None, math.nan])
def test_scores_are_refused_in_every_form(spark, rows, bad):
    df = spark.createDataFrame(
        [(n, 0, float(n), n % 2) for n in range(9)] + [(9, 0, bad, 1)],
        "func_id long, line_idx int, score double, label int",
    )
    with pytest.raises(Exception, match="null or NaN"):
        lines.rank_lines(df, rows_per_range=rows).collect()
    with pytest.raises(Exception, match="null or NaN"):
        lines.topk_effort(df, 0.5, rows).collect()
    with pytest.raises(Exception, match="null or NaN"):
        global_rank(df, ["score"], "at", rows).collect()
    stops(metrics.threshold_predict(df, prob="score"))
    with pytest.raises(Exception, match="null or NaN"):
        metrics.eval_loss(df.withColumn("idx", F.col("func_id")), 2, loss="score").collect()


@pytest.mark.parametrize("rows", FORMS)
def test_any_order_type_works_in_every_form(spark, rows):
    names = ["", "a", "a\u0000", "ab", "é", "zz", "prefix-shared-by-all-1", "prefix-shared-by-all-2", "日本"]
    df = spark.createDataFrame(list(zip(names * 3, range(27))), "name string, n long")
    df = df.withColumn("day", F.date_add(F.lit("2024-02-27").cast("date"), F.col("n").cast("int")))
    df = df.withColumn("time", F.col("day").cast("timestamp"))
    got = global_rank(df, ["name", "n"], "at", rows).collect()
    assert [r["name"] for r in sorted(got, key=lambda r: r["at"])] == sorted(names * 3, key=str.encode)
    for order in ("day", "time"):
        got = global_rank(df, [order], "at", rows).collect()
        assert sorted(r["at"] for r in got) == list(range(1, 28))
        assert [r[order] for r in sorted(got, key=lambda r: r["at"])] == sorted(r[order] for r in got)
    with pytest.raises(TypeError):
        with_ranges(df.withColumn("parts", F.array("n")), ["parts"], rows)


@pytest.mark.parametrize("rows", FORMS)
def test_classes_first_seen_by_name(spark, rows):
    df = spark.createDataFrame(
        [(f"row-{n}", f"c{n % 5}", "train" if n % 2 else "test") for n in range(20)],
        "idx string, class string, split string",
    )
    got = classes.class_index(classes.class_stats(df), rows).orderBy("class_id").collect()
    first = {r["class"]: r["class_id"] for r in got}
    seen = sorted(df.collect(), key=lambda r: (r["split"] != "train", r["idx"]))
    assert sorted(first, key=first.get) == list(dict.fromkeys(r["class"] for r in seen))


def test_a_diverged_epoch_is_never_best(spark):
    log = spark.createDataFrame(
        [("a", 1, 0.7), ("a", 2, math.nan), ("a", 3, 0.8), ("a", 4, None), ("b", 1, math.nan)],
        "run string, epoch int, value double",
    )
    for higher, floor, epoch in ((True, None, 3), (False, None, 1), (True, 0.0, 3)):
        got = metrics.best_run(log, higher, floor).collect()
        assert [(r["run"], r["epoch"]) for r in got] == [("a", epoch)]


def test_alignment_refuses_repeated_and_missing_keys(spark, tmp_path):
    examples = spark.createDataFrame([(1, "x"), (2, "y")], "idx long, code string")
    for preds in ([(1, 0), (1, 1), (2, 0)], [(1, 0)], [(1, 0), (2, 0), (3, 0)], [(1, 0), (2, 1), (None, 1)]):
        frame = spark.createDataFrame(preds, "idx long, pred int")
        stops(clean.align_predictions(examples, frame))
        with pytest.raises(Exception):
            writers.write_raw_preds(examples, frame, str(tmp_path / f"out{len(preds)}{preds[-1][0]}"))
    stops(clean.align_predictions(examples.union(examples.limit(1)), examples.select("idx")))
    good = spark.createDataFrame([(2, 0), (1, 1)], "idx long, pred int")
    assert clean.align_predictions(examples, good).count() == 2


def test_scorers_that_give_nan_or_too_few(spark):
    df = spark.createDataFrame([(n, float(n)) for n in range(6)], "idx long, x double")

    def load_nan():
        return lambda rows: [math.nan if x == 3 else x for x in rows["x"]]

    got = {r["idx"]: (r["prob"], r["error"]) for r in scoring.score_with(df, load_nan, ["x"]).collect()}
    assert got[3] == (None, "score is NaN") and got[2] == (2.0, None)

    def load_few():
        return lambda rows: list(rows["x"][rows["x"] != 4])

    got = {r["idx"]: (r["prob"], r["error"]) for r in scoring.score_with(df, load_few, ["x"]).collect()}
    assert got[4] == (None, "0 scores for 1 rows") and got[5] == (5.0, None)


def test_flaw_marks_before_a_last_newline_stay(spark):
    df = spark.createDataFrame([("/~a/~\n",), ("/~/a/~/b/~/",), (None,)], "flaws string")
    got = [r[0] for r in df.select(text.parse_flaw_lines(F.col("flaws"))).collect()]
    assert got == [["a/~"], ["a", "b"], []]
