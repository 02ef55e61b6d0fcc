"""Counts and scores of predicted classes, best runs, and reports over many thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.operators import curves
from codewarden.operators.ordered import ROWS_PER_RANGE, global_rank
from codewarden.support import checked_score, ratio


def threshold_predict(preds: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """Add ``pred``: 1 where the probability is strictly above the threshold. A missing or NaN
    probability stops the job."""
    return preds.withColumn("pred", (checked_score(F.col(prob), prob) > threshold).cast("int"))


def binary_counts(label: Column, positive: Column) -> dict[str, Column]:
    """The four cells of a binary confusion matrix as aggregates of one pass."""
    truth = label == 1
    return {
        "tn": F.count_if(~truth & ~positive),
        "fp": F.count_if(~truth & positive),
        "fn": F.count_if(truth & ~positive),
        "tp": F.count_if(truth & positive),
    }


def confusion_matrix(
    preds: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()
) -> DataFrame:
    cells = binary_counts(F.col(label), F.col(pred) == 1)
    return preds.groupBy(*keys).agg(*[c.alias(name) for name, c in cells.items()])


def confusion_matrix_multi(
    preds: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per pair of true and predicted class."""
    return preds.groupBy(
        *keys, F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return preds.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def class_scores(
    matrix: DataFrame, class_names: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class from the class by class counts.

    ``class_names`` (class_id, class) adds names, and zero rows for classes that occur nowhere.
    """
    correct = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    # One row per class and side of the matrix, so one aggregate covers both.
    sides = matrix.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class_id"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("pred").alias("class_id"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ),
    )
    if class_names is not None:
        absent = class_names.select(
            F.col("class_id").cast("int").alias("class_id"),
            *[F.lit(0).cast("long").alias(c) for c in ("support", "predicted", "hit")],
        )
        sides = sides.unionByName(absent)
    per_class = sides.groupBy(*keys, "class_id").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hit").alias("hit"),
    )
    precision = ratio(F.col("hit"), F.col("predicted"))
    recall = ratio(F.col("hit"), F.col("support"))
    scored = per_class.select(
        *keys,
        "class_id",
        precision.alias("precision"),
        recall.alias("recall"),
        f1_of(precision, recall).alias("f1"),
        "support",
        "hit",
    )
    if class_names is None:
        return scored.withColumn("class", F.col("class_id").cast("string"))
    names = class_names.select(F.col("class_id").cast("int").alias("class_id"), "class")
    return scored.join(names, "class_id", "left")


def class_report(
    matrix: DataFrame, class_names: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average."""
    scored = class_scores(matrix, class_names, keys)
    averages = scored.groupBy(*keys).agg(
        F.sum("support").alias("rows"),
        F.sum("hit").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
    )
    share = ratio(F.col("hits"), F.col("rows"))

    def line(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("rows").alias("support"),
        )

    summary = averages.select(
        *keys,
        F.inline(
            F.array(
                line("accuracy", share, share, share),
                *[
                    line(f"{kind} avg", *[F.col(f"{kind}_{m}") for m in ("precision", "recall", "f1")])
                    for kind in ("macro", "weighted")
                ],
            )
        ),
    )
    return scored.select(*keys, "class", "precision", "recall", "f1", "support").unionByName(summary)


def macro_scores(
    matrix: DataFrame, class_names: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Unweighted means over the classes."""
    return (
        class_scores(matrix, class_names, keys)
        .groupBy(*keys)
        .agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])
    )


def scores_from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Closed forms of the binary measures; 0 where undefined."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    pos_pre, pos_rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    neg_pre, neg_rec = ratio(tn, tn + fn), ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": pos_pre,
        "recall": pos_rec,
        "f1": f1_of(pos_pre, pos_rec),
        "neg_precision": neg_pre,
        "neg_recall": neg_rec,
        "neg_f1": f1_of(neg_pre, neg_rec),
        "mcc": ratio(
            tp * tn - fp * fn,
            F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn),
        ),
    }


def binary_scores(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 of the positive label."""
    counts = confusion_matrix(preds, label, pred)
    scores = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return counts.select(*[scores[m].alias(m) for m in ("precision", "recall", "f1")])


def mcc(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Matthews correlation; 0 where a row or column of the matrix is empty."""
    counts = confusion_matrix(preds, label, pred)
    scores = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return counts.select(scores["mcc"].alias("mcc"))


def _cells_at(above: Column) -> list[Column]:
    """Confusion counts of a score table when the scores in ``above`` are predicted positive."""
    return [
        F.coalesce(F.sum(F.when(side, F.col(column))), F.lit(0)).alias(name)
        for name, column, side in (
            ("tn", "neg", ~above),
            ("fp", "neg", above),
            ("fn", "pos", ~above),
            ("tp", "pos", above),
        )
    ]


def binary_report(preds: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """All test measures of a binary classifier at threshold 0.5, as one row.

    The counts at the threshold are read off the same score table as the two areas.
    """
    table = curves.score_table(preds, label, prob)
    one = table.agg(
        *_cells_at(F.col("score") > 0.5),
        curves.ap_of_table().alias("PRC_AUC"),
        curves.auc_of_table().alias("ROC_AUC"),
    )
    s = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return one.select(
        s["accuracy"].alias("Acc"),
        *[F.col(c).alias(c.upper()) for c in ("tp", "tn", "fp", "fn")],
        s["neg_precision"].alias("Neg_pre"),
        s["neg_recall"].alias("Neg_rec"),
        s["neg_f1"].alias("Neg_f1"),
        s["precision"].alias("Pos_pre"),
        s["recall"].alias("Pos_rec"),
        s["f1"].alias("Pos_f1"),
        "PRC_AUC",
        "ROC_AUC",
    )


def multi_threshold_report(
    preds: DataFrame, thresholds: Sequence[float], label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Macro and per-class scores, MCC and AUC at each threshold, from one score table."""
    table = curves.score_table(preds, label, prob)
    counts = [
        F.struct(F.lit(float(t)).alias("threshold"), *_cells_at(F.col("score") > float(t)))
        for t in thresholds
    ]
    rows = table.agg(
        F.array(*counts).alias("counts"), curves.auc_of_table().alias("roc_auc")
    ).select("roc_auc", F.inline("counts"))
    s = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return rows.select(
        "threshold",
        ((s["precision"] + s["neg_precision"]) / 2.0).alias("macro_precision"),
        ((s["recall"] + s["neg_recall"]) / 2.0).alias("macro_recall"),
        ((s["f1"] + s["neg_f1"]) / 2.0).alias("macro_f1"),
        s["neg_precision"].alias("precision_0"),
        s["neg_recall"].alias("recall_0"),
        s["neg_f1"].alias("f1_0"),
        s["precision"].alias("precision_1"),
        s["recall"].alias("recall_1"),
        s["f1"].alias("f1_1"),
        s["mcc"].alias("mcc"),
        "roc_auc",
    )


REPORT_METRICS = ("f1", "macro_f1", "macro_recall")


def quality_report(
    valid: DataFrame,
    test: DataFrame,
    label: str = "label",
    prob: str = "prob",
    metrics: Sequence[str] = REPORT_METRICS,
    inclusive: bool = False,
) -> DataFrame:
    """Thresholds chosen on ``valid``, measured on ``test``.

    Long form (metric, class, measure, value, threshold): class 0, 1 and macro for each metric,
    and a ``best`` row with the test value of the metric itself. The area under the ROC curve has
    no threshold of its own and carries 0.5. Thresholds are chosen as ``score >= t`` but applied
    as ``score > t``; ``inclusive`` applies them as chosen.
    """
    chosen = curves.best_threshold(curves.score_table(valid, label, prob), metrics)
    # One row per metric: the choice becomes literals of the single pass over the test scores.
    cuts = {row["metric"]: row["best_threshold"] for row in chosen.collect()}
    table = curves.score_table(test, label, prob)
    counts = []
    for metric in metrics:
        cut = F.lit(cuts[metric]).cast("double")
        above = F.col("score") >= cut if inclusive else F.col("score") > cut
        counts.append(
            F.struct(F.lit(metric).alias("metric"), cut.alias("threshold"), *_cells_at(above))
        )
    measured = table.agg(F.array(*counts).alias("counts"), curves.auc_of_table().alias("roc_auc"))
    rows = measured.select("roc_auc", F.inline("counts"))
    s = scores_from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    both = {m: (f"neg_{m}", m) for m in ("precision", "recall", "f1")}
    scored = rows.select(
        "metric", "threshold", "roc_auc", *[s[c].alias(c) for pair in both.values() for c in pair]
    ).withColumns({f"macro_{m}": (F.col(n) + F.col(p)) / 2.0 for m, (n, p) in both.items()})

    def line(metric: Column, name: str, measure: Column, value: Column, cut: Column) -> Column:
        return F.struct(
            metric.alias("metric"),
            F.lit(name).alias("class"),
            measure.alias("measure"),
            value.alias("value"),
            cut.alias("threshold"),
        )

    metric, threshold, roc_auc = F.col("metric"), F.col("threshold"), F.lit("roc_auc")
    lines = [
        line(metric, name, F.lit(m), F.col(column), threshold)
        for m, (neg, pos) in both.items()
        for name, column in (("0", neg), ("1", pos), ("macro", f"macro_{m}"))
    ]
    best = F.coalesce(
        *[
            F.when(metric == name, F.col(column))
            for name, column in (
                ("f1", "f1"),
                ("macro_f1", "macro_f1"),
                ("macro_recall", "macro_recall"),
                ("prec", "precision"),
            )
        ]
    )
    lines.append(line(metric, "best", metric, best, threshold))
    # The area belongs to no metric's row: it goes with the first one.
    lines.append(
        F.when(
            metric == metrics[0], line(roc_auc, "best", roc_auc, F.col("roc_auc"), F.lit(0.5))
        )
    )
    return scored.select(F.inline(F.array(*lines))).filter("metric is not null")


def best_run(
    log: DataFrame, higher_is_better: bool = True, floor: float | None = None
) -> DataFrame:
    """Best epoch of each run; the first wins ties, as only a strict improvement counts.

    ``log`` holds (run, epoch, value). ``floor`` is a start value that has to be beaten. An epoch
    without a value, or with NaN, is never best; a run of such epochs only has no best one.
    """
    log = log.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    value = F.col("value") if higher_is_better else -F.col("value")
    if floor is not None:
        log = log.filter(value > (floor if higher_is_better else -floor))
    best = F.max(F.struct(value.alias("v"), (-F.col("epoch")).alias("e")))
    return log.groupBy("run").agg(best.alias("best")).select(
        "run",
        (-F.col("best.e")).alias("epoch"),
        (F.col("best.v") if higher_is_better else -F.col("best.v")).alias("value"),
    )


def line_totals(results: DataFrame) -> DataFrame:
    """All lines and all flaw lines of a result table."""
    return results.agg(
        F.sum("num_lines").alias("total_lines"), F.sum("num_flaw_lines").alias("total_flaw_lines")
    )


def eval_loss(losses: DataFrame, batch_size: int, order: str = "idx", loss: str = "loss") -> DataFrame:
    """Mean of the batch means, batches being runs of ``batch_size`` rows in order."""
    batch = F.floor((F.col("__at") - 1) / batch_size)
    return (
        global_rank(
            losses.select(order, checked_score(F.col(loss), loss).alias(loss)), [order], "__at"
        )
        .groupBy(batch.alias("batch"))
        .agg(F.avg(loss).alias("batch_loss"))
        .agg(F.avg("batch_loss").alias("eval_loss"))
    )
