"""Everything that is read off the ordered scores: areas, curves, best thresholds.

All measures come from one table of distinct scores with the number of positive and negative
rows at each, so ties are settled by grouping and no floating-point join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.operators.ordered import ROWS_PER_RANGE, running_totals
from codewarden.support import checked_score, ratio

# Keeps the F1 of a curve defined where precision and recall are both 0.
F1_GUARD = 1e-13
THRESHOLD_METRICS = ("f1", "macro_f1", "macro_recall", "prec")


def score_table(
    preds: DataFrame,
    label: str = "label",
    prob: str = "prob",
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per key and distinct score, with counts at, below and above it.

    ``pos`` and ``neg`` are the rows at the score, ``pos_le`` and ``neg_le`` those at or below
    it, ``p`` and ``n`` all rows of the key.
    """
    rows = preds.select(
        *keys,
        checked_score(F.col(prob), "score").alias("score"),
        F.when(F.col(label) == 1, 1).otherwise(0).cast("long").alias("pos"),
        F.when(F.col(label) == 1, 0).otherwise(1).cast("long").alias("neg"),
    )
    # Ties collapse before anything is written or ordered.
    grouped = rows.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_totals(
        grouped,
        ["score"],
        {"pos_le": F.col("pos"), "neg_le": F.col("neg")},
        keys=keys,
        grand={"pos_le": "p", "neg_le": "n"},
        rows_per_range=rows_per_range,
    )


def auc_of_table() -> Column:
    """Aggregate over a score table: the area under the ROC curve, tied pairs counting half.

    Null when a class is missing.
    """
    below = F.col("neg_le") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0)))
    pairs = F.max("p").cast("double") * F.max("n").cast("double")
    return won / F.nullif(pairs, F.lit(0.0))


def ap_of_table() -> Column:
    """Aggregate over a score table: precision at each score, weighted by the recall gained."""
    tp = F.col("p") - F.col("pos_le") + F.col("pos")
    fp = F.col("n") - F.col("neg_le") + F.col("neg")
    gained = F.sum(F.col("pos").cast("double") * ratio(tp, tp + fp))
    return gained / F.nullif(F.max("p").cast("double"), F.lit(0.0))


def roc_auc(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys).agg(auc_of_table().alias("roc_auc"))


def average_precision(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys).agg(ap_of_table().alias("average_precision"))


def _at_or_above(table: DataFrame) -> DataFrame:
    return table.withColumns(
        {
            "tp": F.col("p") - F.col("pos_le") + F.col("pos"),
            "fp": F.col("n") - F.col("neg_le") + F.col("neg"),
        }
    )


def pr_curve(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of ``score >= threshold`` at each distinct score, and the end point
    (1, 0), which has no threshold."""
    points = _at_or_above(table).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
    )
    ends = table.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(ends)


def roc_curve(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate of ``score >= threshold``, and the start (0, 0) at infinity."""
    points = _at_or_above(table).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("n")).alias("fpr"),
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )
    starts = table.groupBy(*keys).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(starts)


def _curve_f1(precision: Column, recall: Column) -> Column:
    return F.lit(2.0) * precision * recall / (precision + recall + F.lit(F1_GUARD))


def paired_curves(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both classes' curves at each threshold: the positive class takes ``score >= t``, the
    negative class ``1 - score >= 1 - t``, that is ``score <= t``."""
    t = _at_or_above(table).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"),
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
        ratio(F.col("fp"), F.col("n")).alias("fpr"),
        ratio(F.col("neg_le"), F.col("pos_le") + F.col("neg_le")).alias("neg_prec"),
        ratio(F.col("neg_le"), F.col("n")).alias("neg_rec"),
    )
    scored = t.withColumns(
        {
            "f1_pos": _curve_f1(F.col("prec"), F.col("tpr")),
            "f1_neg": _curve_f1(F.col("neg_prec"), F.col("neg_rec")),
            "macro_recall": (F.col("tpr") + 1.0 - F.col("fpr")) / 2.0,
        }
    )
    return scored.select(
        *keys,
        "threshold",
        "f1_pos",
        "f1_neg",
        ((F.col("f1_pos") + F.col("f1_neg")) / 2.0).alias("macro_f1"),
        "macro_recall",
        "prec",
    )


def best_threshold(
    table: DataFrame, metrics: Sequence[str] = THRESHOLD_METRICS, keys: Sequence[str] = ()
) -> DataFrame:
    """Best value of each metric over the thresholds, and where it is reached.

    Ties go to the lowest threshold, except for ``macro_recall``, whose curve runs from high to
    low thresholds and starts at (0, 0) with an infinite one.
    """
    unknown = sorted(set(metrics) - set(THRESHOLD_METRICS))
    if unknown:
        raise NotImplementedError(f"unknown metric: {', '.join(unknown)}")
    column = {"f1": "f1_pos", "macro_f1": "macro_f1", "prec": "prec"}
    best = []
    for metric in metrics:
        if metric == "macro_recall":
            start = F.struct(F.lit(0.5).alias("value"), F.lit(float("inf")).alias("order"))
            top = F.max(F.struct(F.col("macro_recall").alias("value"), F.col("threshold").alias("order")))
            top = F.greatest(top, start)
            pick = F.struct(
                F.lit(metric).alias("metric"),
                top["value"].alias("best_value"),
                top["order"].alias("best_threshold"),
            )
        else:
            top = F.max(
                F.struct(F.col(column[metric]).alias("value"), (-F.col("threshold")).alias("order"))
            )
            pick = F.struct(
                F.lit(metric).alias("metric"),
                top["value"].alias("best_value"),
                (-top["order"]).alias("best_threshold"),
            )
        best.append(pick)
    return (
        paired_curves(table, keys)
        .groupBy(*keys)
        .agg(F.array(*best).alias("best"))
        .select(*keys, F.inline("best"))
    )
