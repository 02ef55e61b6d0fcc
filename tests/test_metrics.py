"""Hand-computed cases of the evaluation operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import curves, metrics, running


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, prob double")


def one(df):
    return df.first()[0]


def test_auc_with_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]
    assert one(curves.roc_auc(curves.score_table(preds(spark, rows)))) == 0.875


def test_auc_of_one_class_is_null(spark):
    rows = [(0, 0.5), (0, 0.7)]
    assert one(curves.roc_auc(curves.score_table(preds(spark, rows)))) is None


def test_auc_properties(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(40) / 40.0) for _ in range(300)]
    df = preds(spark, rows)
    pairs = [(a, b) for la, a in rows if la == 1 for lb, b in rows if lb == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    auc = one(curves.roc_auc(curves.score_table(df)))
    assert auc == pytest.approx(want)
    flipped = df.withColumn("prob", 1 - F.col("prob"))
    assert one(curves.roc_auc(curves.score_table(flipped))) == pytest.approx(1 - auc)
    cubed = df.withColumn("prob", F.pow("prob", F.lit(3)))
    assert one(curves.roc_auc(curves.score_table(cubed))) == pytest.approx(auc)


def test_average_precision(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)]
    got = one(curves.average_precision(curves.score_table(preds(spark, rows))))
    assert got == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_thresholds_are_chosen_inclusive_and_applied_strictly(spark):
    df = preds(spark, [(0, 0.2), (1, 0.6)])
    best = curves.best_threshold(curves.score_table(df), ["f1"]).first()
    assert best["best_threshold"] == 0.6
    report = metrics.quality_report(df, df).collect()
    f1 = [r for r in report if (r["metric"], r["class"], r["measure"]) == ("f1", "best", "f1")]
    assert f1[0]["value"] == 0.0
    inclusive = metrics.quality_report(df, df, inclusive=True).collect()
    f1 = [r for r in inclusive if (r["metric"], r["class"], r["measure"]) == ("f1", "best", "f1")]
    assert f1[0]["value"] == 1.0


def test_one_metric_only(spark):
    df = preds(spark, [(0, 0.2), (1, 0.6)])
    report = metrics.quality_report(df, df, metrics=["f1"]).collect()
    assert {r["metric"] for r in report} == {"f1", "roc_auc"}


def test_unknown_metric(spark):
    with pytest.raises(NotImplementedError):
        curves.best_threshold(curves.score_table(preds(spark, [(1, 0.5)])), ["f2"])


def test_tie_order_of_best_threshold(spark):
    # Thresholds .4 and .8 give the same F1; .4 is lower. The ROC walk meets the higher first.
    df = preds(spark, [(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.1)])
    got = {r["metric"]: r for r in curves.best_threshold(curves.score_table(df)).collect()}
    assert got["macro_recall"]["best_threshold"] == 0.9
    assert got["f1"]["best_threshold"] == 0.4
    assert got["prec"]["best_threshold"] == 0.9


def test_worse_than_chance_keeps_the_start_of_the_curve(spark):
    df = preds(spark, [(1, 0.1), (0, 0.9)])
    got = curves.best_threshold(curves.score_table(df), ["macro_recall"]).first()
    assert got["best_value"] == 0.5 and math.isinf(got["best_threshold"])


def test_curve_ends(spark):
    table = curves.score_table(preds(spark, [(1, 0.5), (0, 0.2)]))
    ends = curves.pr_curve(table).filter("threshold is null").first()
    assert (ends["precision"], ends["recall"]) == (1.0, 0.0)
    start = curves.roc_curve(table).orderBy(F.desc("threshold")).first()
    assert (start["fpr"], start["tpr"]) == (0.0, 0.0)


def test_report_of_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, class string")
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion_matrix_multi(df), names).collect()}
    assert report["c"]["support"] == 0 and report["c"]["f1"] == 0.0
    assert report["a"]["precision"] == 1.0 and report["a"]["recall"] == 0.5
    assert report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert report["macro avg"]["precision"] == pytest.approx(0.5)
    assert sum(report[c]["support"] for c in "abc") == 3


def test_mcc_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    assert one(metrics.mcc(df)) == 0.0


def test_best_run_keeps_the_first_of_equals(spark):
    log = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.0)],
        "run string, epoch int, value double",
    )
    assert metrics.best_run(log).filter("run = 'a'").first()["epoch"] == 2
    assert metrics.best_run(log, higher_is_better=False).filter("run = 'a'").first()["epoch"] == 1
    assert metrics.best_run(log, floor=0.0).count() == 1


def test_running_report_counts_skipped_rows(spark):
    df = spark.range(250).select(
        F.col("id").alias("idx"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.lit(1).alias("pred"),
        (F.col("id") % 10 == 0).alias("skip"),
    )
    got = running.running_report(df, skipped="skip").orderBy("rows_read").collect()
    assert [(r["rows_read"], r["rows_skipped"]) for r in got] == [(100, 10), (200, 20)]
    assert got[0]["precision"] == pytest.approx(50 / 90)


def test_eval_loss_is_a_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 8.0)], "idx long, loss double")
    assert one(metrics.eval_loss(df, 2)) == 5.0
