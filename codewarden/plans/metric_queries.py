"""Registered queries: evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import clean, curves, metrics, running
from codewarden.plans import views
from codewarden.plans.registry import query, round_doubles
from codewarden.plans.views import sql

_CELLS = """CAST(count_if(label <> 1 AND NOT (prob > 0.5)) AS BIGINT) AS tn,
       CAST(count_if(label <> 1 AND prob > 0.5) AS BIGINT) AS fp,
       CAST(count_if(label = 1 AND NOT (prob > 0.5)) AS BIGINT) AS fn,
       CAST(count_if(label = 1 AND prob > 0.5) AS BIGINT) AS tp"""


def _ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0)"


def _f1(precision: str, recall: str) -> str:
    return f"coalesce(2 * ({precision}) * ({recall}) / nullif(({precision}) + ({recall}), 0), 0)"


_PP, _PR = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
_NP, _NR = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp")
_MCC = (
    "coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(tp + fp) * "
    "sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)"
)
_AUC = "sum(pos * (neg_le - neg + neg / 2)) / nullif(max(p) * max(n), 0)"
_AP = "sum(pos * tp / (tp + fp)) / nullif(max(p), 0)"


def _predicted(spark, sf):
    return metrics.threshold_predict(views.scores(spark, sf))


@query(
    "threshold_predict",
    sql("SELECT idx, prob, CAST(prob > 0.5 AS INTEGER) AS pred FROM scores", "scores"),
)
def threshold_predict(spark, sf):
    return _predicted(spark, sf).select("idx", "prob", "pred")


@query("confusion_matrix", sql(f"SELECT {_CELLS} FROM scores", "scores"))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_predicted(spark, sf))


@query(
    "confusion_matrix_multi",
    sql(
        "SELECT label, pred, count(*) AS n FROM class_preds GROUP BY label, pred", "class_preds"
    ),
)
def confusion_matrix_multi(spark, sf):
    return metrics.confusion_matrix_multi(_class_preds(spark, sf))


def _class_preds(spark, sf):
    from codewarden.functions.numeric import argmax_class

    return views.class_probs(spark, sf).withColumn("pred", argmax_class(F.col("probs")))


_REPORT = f"""SELECT class, support, precision, recall, {_f1('precision', 'recall')} AS f1, hit
  FROM (SELECT c.class, support, hit, {_ratio('hit', 'predicted')} AS precision,
          {_ratio('hit', 'support')} AS recall
        FROM (SELECT 'class-' || k AS class, k AS class_id,
                (SELECT count(*) FROM class_preds WHERE label = k) AS support,
                (SELECT count(*) FROM class_preds WHERE pred = k) AS predicted,
                (SELECT count(*) FROM class_preds WHERE pred = k AND label = k) AS hit
              FROM generate_series(0, 3) AS g(k)) c)"""


def _names(spark):
    return spark.range(4).select(
        F.col("id").cast("int").alias("class_id"),
        F.concat(F.lit("class-"), F.col("id").cast("string")).alias("class"),
    )


@query(
    "class_report",
    sql(
        f"""SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
            SELECT class, precision, recall, f1, support FROM ({_REPORT})
            UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support),
              sum(hit) / sum(support), sum(support) FROM ({_REPORT})
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
              FROM ({_REPORT})
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
              sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
              FROM ({_REPORT}))""",
        "class_preds",
    ),
)
def class_report(spark, sf):
    matrix = metrics.confusion_matrix_multi(_class_preds(spark, sf))
    return round_doubles(metrics.class_report(matrix, _names(spark)))


@query(
    "macro_scores",
    sql(
        f"""SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
              round(avg(f1), 6) AS f1 FROM ({_REPORT})""",
        "class_preds",
    ),
)
def macro_scores(spark, sf):
    matrix = metrics.confusion_matrix_multi(_class_preds(spark, sf))
    return round_doubles(metrics.macro_scores(matrix, _names(spark)))


@query(
    "accuracy",
    sql(
        "SELECT round(avg(CAST(label = CAST(prob > 0.5 AS INTEGER) AS DOUBLE)), 6) AS accuracy FROM scores",
        "scores",
    ),
)
def accuracy(spark, sf):
    return round_doubles(metrics.accuracy(_predicted(spark, sf)))


@query(
    "binary_scores",
    sql(
        f"""SELECT round({_PP}, 6) AS precision, round({_PR}, 6) AS recall,
              round({_f1(_PP, _PR)}, 6) AS f1 FROM (SELECT {_CELLS} FROM scores)""",
        "scores",
    ),
)
def binary_scores(spark, sf):
    return round_doubles(metrics.binary_scores(_predicted(spark, sf)))


@query("mcc", sql(f"SELECT round({_MCC}, 6) AS mcc FROM (SELECT {_CELLS} FROM scores)", "scores"))
def mcc(spark, sf):
    return round_doubles(metrics.mcc(_predicted(spark, sf)))


@query("roc_auc", sql(f"SELECT round({_AUC}, 6) AS roc_auc FROM curve", "curve"))
def roc_auc(spark, sf):
    return round_doubles(curves.roc_auc(curves.score_table(views.scores(spark, sf))))


@query(
    "average_precision", sql(f"SELECT round({_AP}, 6) AS average_precision FROM curve", "curve")
)
def average_precision(spark, sf):
    return round_doubles(curves.average_precision(curves.score_table(views.scores(spark, sf))))


@query(
    "pr_curve",
    sql(
        """SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
             round(tp / p, 6) AS recall FROM curve
           UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0""",
        "curve",
    ),
)
def pr_curve(spark, sf):
    return round_doubles(curves.pr_curve(curves.score_table(views.scores(spark, sf))))


@query(
    "roc_curve",
    sql(
        """SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr
           FROM curve
           UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0""",
        "curve",
    ),
)
def roc_curve(spark, sf):
    return round_doubles(curves.roc_curve(curves.score_table(views.scores(spark, sf))))


_G = "0.0000000000001"
_PAIRED = f"""SELECT score, 2 * (tp / (tp + fp)) * (tp / p) / ((tp / (tp + fp)) + (tp / p) + {_G}) AS f1,
    2 * (neg_le / (pos_le + neg_le)) * (neg_le / n)
      / ((neg_le / (pos_le + neg_le)) + (neg_le / n) + {_G}) AS f1_neg,
    (tp / p + 1 - fp / n) / 2 AS macro_recall, tp / (tp + fp) AS prec FROM curve"""


@query(
    "curve_pairing",
    sql(
        f"""SELECT round(score, 6) AS threshold, round(f1, 6) AS f1_pos, round(f1_neg, 6) AS f1_neg,
              round((f1 + f1_neg) / 2, 6) AS macro_f1, round(macro_recall, 6) AS macro_recall,
              round(prec, 6) AS prec FROM ({_PAIRED})""",
        "curve",
    ),
)
def curve_pairing(spark, sf):
    return round_doubles(curves.paired_curves(curves.score_table(views.scores(spark, sf))))


def _best(metric: str, value: str, order: str) -> str:
    return (
        f"(SELECT '{metric}' AS metric, {value} AS best_value, score AS best_threshold "
        f"FROM ({_PAIRED}) ORDER BY {value} DESC, score {order} LIMIT 1)"
    )


_BEST = " UNION ALL ".join(
    [
        _best("f1", "f1", "ASC"),
        _best("macro_f1", "(f1 + f1_neg) / 2", "ASC"),
        _best("prec", "prec", "ASC"),
    ]
) + (
    " UNION ALL (SELECT * FROM (SELECT 'macro_recall', macro_recall AS v, score AS s FROM "
    f"({_PAIRED}) UNION ALL SELECT 'macro_recall', 0.5, CAST('infinity' AS DOUBLE)) "
    "ORDER BY v DESC, s DESC LIMIT 1)"
)


@query(
    "best_threshold",
    sql(
        f"""SELECT metric, round(best_value, 6) AS best_value,
              round(best_threshold, 6) AS best_threshold FROM ({_BEST})""",
        "curve",
    ),
)
def best_threshold(spark, sf):
    return round_doubles(curves.best_threshold(curves.score_table(views.scores(spark, sf))))


def _split_curve(name: str, split: str) -> str:
    """The curve of one split of the predictions, under a name of its own."""
    # Views of this shape hold target, prob and split.
    return f"""{name} AS (SELECT prob AS score, CAST(sum(target) AS DOUBLE) AS pos,
        CAST(sum(1 - target) AS DOUBLE) AS neg, CAST(sum(sum(target)) OVER () AS DOUBLE) AS p,
        CAST(sum(sum(1 - target)) OVER () AS DOUBLE) AS n,
        CAST(sum(sum(target)) OVER (ORDER BY prob) AS DOUBLE) AS pos_le,
        CAST(sum(sum(1 - target)) OVER (ORDER BY prob) AS DOUBLE) AS neg_le
      FROM predictions WHERE split = '{split}' GROUP BY prob)"""


_QUALITY = f"""{{views}},
{_split_curve('valid_curve', 'valid')},
{_split_curve('test_curve', 'test')},
curve AS (SELECT *, p - pos_le + pos AS tp, n - neg_le + neg AS fp FROM valid_curve),
best AS (SELECT * FROM ({_BEST}) WHERE metric <> 'prec'),
cells AS (SELECT metric, best_threshold, count_if(target = 1 AND prob > best_threshold) AS tp,
    count_if(target = 0 AND prob > best_threshold) AS fp,
    count_if(target = 1 AND prob <= best_threshold) AS fn,
    count_if(target = 0 AND prob <= best_threshold) AS tn
  FROM best, predictions WHERE split = 'test' GROUP BY metric, best_threshold),
measured AS (SELECT metric, best_threshold AS threshold, {_PP} AS pp, {_PR} AS pr, {_NP} AS np, {_NR} AS nr,
    {_f1(_PP, _PR)} AS pf, {_f1(_NP, _NR)} AS nf FROM cells)
SELECT metric, class, measure, round(value, 6) AS value, round(threshold, 6) AS threshold FROM (
  SELECT metric, '0' AS class, 'precision' AS measure, np AS value, threshold FROM measured
  UNION ALL SELECT metric, '0', 'recall', nr, threshold FROM measured
  UNION ALL SELECT metric, '0', 'f1', nf, threshold FROM measured
  UNION ALL SELECT metric, '1', 'precision', pp, threshold FROM measured
  UNION ALL SELECT metric, '1', 'recall', pr, threshold FROM measured
  UNION ALL SELECT metric, '1', 'f1', pf, threshold FROM measured
  UNION ALL SELECT metric, 'macro', 'precision', (np + pp) / 2, threshold FROM measured
  UNION ALL SELECT metric, 'macro', 'recall', (nr + pr) / 2, threshold FROM measured
  UNION ALL SELECT metric, 'macro', 'f1', (nf + pf) / 2, threshold FROM measured
  UNION ALL SELECT metric, 'best', metric, CASE metric WHEN 'f1' THEN pf
      WHEN 'macro_f1' THEN (nf + pf) / 2 ELSE (nr + pr) / 2 END, threshold FROM measured
  UNION ALL SELECT 'roc_auc', 'best', 'roc_auc',
    sum(pos * (neg_le - neg + neg / 2)) / nullif(max(p) * max(n), 0), 0.5 FROM test_curve)"""


@query("quality_report", _QUALITY.replace("{views}", sql("", "predictions").rstrip()))
def quality_report(spark, sf):
    preds = views.predictions(spark, sf).select("split", "prob", F.col("target").alias("label"))
    report = metrics.quality_report(
        preds.filter("split = 'valid'"), preds.filter("split = 'test'")
    )
    return round_doubles(report)


_BIG = """predictions AS (SELECT label AS target, prob,
    CASE WHEN idx % 2 = 0 THEN 'valid' ELSE 'test' END AS split FROM scores)"""


@query(
    "quality_report_items",
    _QUALITY.replace("{views}", sql("", "scores").rstrip() + ",\n" + _BIG),
)
def quality_report_items(spark, sf):
    """The report over one prediction per line item: even ids choose, odd ids are measured."""
    preds = views.scores(spark, sf)
    report = metrics.quality_report(preds.filter("idx % 2 = 0"), preds.filter("idx % 2 <> 0"))
    return round_doubles(report)


_THRESHOLDS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query(
    "multi_threshold_report",
    sql(
        f"""SELECT threshold, round((np + pp) / 2, 6) AS macro_precision,
              round((nr + pr) / 2, 6) AS macro_recall, round((nf + pf) / 2, 6) AS macro_f1,
              round(np, 6) AS precision_0, round(nr, 6) AS recall_0, round(nf, 6) AS f1_0,
              round(pp, 6) AS precision_1, round(pr, 6) AS recall_1, round(pf, 6) AS f1_1,
              round(mcc, 6) AS mcc, round((SELECT {_AUC} FROM curve), 6) AS roc_auc
            FROM (SELECT threshold, {_PP} AS pp, {_PR} AS pr, {_NP} AS np, {_NR} AS nr,
                    {_f1(_PP, _PR)} AS pf, {_f1(_NP, _NR)} AS nf, {_MCC} AS mcc
                  FROM (SELECT threshold, count_if(label = 1 AND prob > threshold) AS tp,
                          count_if(label = 0 AND prob > threshold) AS fp,
                          count_if(label = 1 AND prob <= threshold) AS fn,
                          count_if(label = 0 AND prob <= threshold) AS tn
                        FROM scores, (SELECT CAST(unnest({list(_THRESHOLDS)}) AS DOUBLE) AS threshold)
                        GROUP BY threshold))""",
        "curve",
    ),
)
def multi_threshold_report(spark, sf):
    return round_doubles(metrics.multi_threshold_report(views.scores(spark, sf), _THRESHOLDS))


_BINARY = f"""SELECT round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6) AS "Acc", tp AS "TP", tn AS "TN",
      fp AS "FP", fn AS "FN", round({_NP}, 6) AS "Neg_pre", round({_NR}, 6) AS "Neg_rec",
      round({_f1(_NP, _NR)}, 6) AS "Neg_f1", round({_PP}, 6) AS "Pos_pre", round({_PR}, 6) AS "Pos_rec",
      round({_f1(_PP, _PR)}, 6) AS "Pos_f1", round((SELECT {_AP} FROM curve), 6) AS "PRC_AUC",
      round((SELECT {_AUC} FROM curve), 6) AS "ROC_AUC"
    FROM (SELECT {_CELLS} FROM scores)"""


@query("binary_report", sql(_BINARY, "curve"))
def binary_report(spark, sf):
    return round_doubles(metrics.binary_report(views.scores(spark, sf)))


@query(
    "best_run",
    sql(
        """SELECT run, epoch, round(value, 6) AS value FROM (
             SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS r
             FROM metric_log WHERE value > 0) WHERE r = 1""",
        "metric_log",
    ),
)
def best_run(spark, sf):
    return round_doubles(metrics.best_run(views.metric_log(spark, sf), floor=0.0))


@query(
    "best_run_lowest",
    sql(
        """SELECT run, epoch, round(value, 6) AS value FROM (
             SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, epoch) AS r
             FROM metric_log) WHERE r = 1""",
        "metric_log",
    ),
)
def best_run_lowest(spark, sf):
    return round_doubles(
        metrics.best_run(views.metric_log(spark, sf), higher_is_better=False)
    )


@query(
    "running_report",
    sql(
        f"""WITH seen AS (SELECT row_number() OVER (ORDER BY event_id) AS at, (event_id % 100) / 100.0 AS score,
              event_type = 'error' AS positive FROM events QUALIFY NOT value < 5),
            won AS (SELECT greatest(p.at, n.at) AS upto,
                sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS won
              FROM seen p JOIN seen n ON p.positive AND NOT n.positive GROUP BY 1)
            SELECT rows_read, rows_skipped, round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
              round({_PP}, 6) AS precision, round({_PR}, 6) AS recall, round({_f1(_PP, _PR)}, 6) AS f1,
              round((SELECT sum(won) FROM won WHERE upto <= rows_read) / nullif((tp + fn) * (fp + tn), 0), 6)
                AS roc_auc
            FROM (SELECT seen AS rows_read,
                CAST(sum(skip) OVER w AS BIGINT) AS rows_skipped,
                sum((1 - skip) * CAST(label = 1 AND pred = 1 AS INTEGER)) OVER w AS tp,
                sum((1 - skip) * CAST(label = 0 AND pred = 1 AS INTEGER)) OVER w AS fp,
                sum((1 - skip) * CAST(label = 1 AND pred = 0 AS INTEGER)) OVER w AS fn,
                sum((1 - skip) * CAST(label = 0 AND pred = 0 AS INTEGER)) OVER w AS tn
              FROM (SELECT row_number() OVER (ORDER BY event_id) AS seen,
                  CAST(event_type = 'error' AS INTEGER) AS label,
                  CAST((event_id % 100) / 100.0 > 0.5 AS INTEGER) AS pred,
                  CAST(value < 5 AS INTEGER) AS skip FROM events)
              WINDOW w AS (ORDER BY seen ROWS UNBOUNDED PRECEDING))
            WHERE rows_read % 100 = 0"""
    ),
)
def running_report(spark, sf):
    return round_doubles(
        running.running_report(
            running_events(spark, sf), "event_id", skipped="skip", score="score"
        )
    )


def running_events(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("event_id") % 100 / 100.0 > 0.5).cast("int").alias("pred"),
        (F.col("value") < 5).alias("skip"),
        (F.col("event_id") % 100 / 100.0).alias("score"),
    )


@query(
    "line_totals",
    sql(
        """SELECT CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0))) AS BIGINT)
             AS total_lines,
             (SELECT CAST(sum(label) AS BIGINT) FROM line_rows) AS total_flaw_lines FROM documents""",
        "line_rows",
    ),
)
def line_totals(spark, sf):
    return metrics.line_totals(function_results(spark, sf))


def function_results(spark, sf):
    """One row per document with its line counts and a prediction."""
    lines = F.size(F.filter("lines", lambda x: F.length(x["line"]) > 0))
    flaws = F.size(F.filter("lines", lambda x: x["label"] == 1))
    prob = (F.col("func_id") * 7919 % 700 + 300) / 1000.0
    return views.line_arrays(spark, sf).select(
        "func_id",
        lines.alias("num_lines"),
        flaws.alias("num_flaw_lines"),
        prob.alias("prob"),
        (prob > 0.5).cast("int").alias("pred"),
    )


@query(
    "class_portions",
    sql(
        """SELECT round(avg(CAST(target = 1 AS DOUBLE)), 6) AS pos_portion,
             round(1 - avg(CAST(target = 1 AS DOUBLE)), 6) AS neg_portion FROM functions""",
        "functions",
    ),
)
def class_portions(spark, sf):
    from codewarden.operators.classes import class_portions as portions

    return round_doubles(portions(views.functions(spark, sf)))


@query("dataset_size", sql("SELECT split, count(*) AS n FROM functions GROUP BY split", "functions"))
def dataset_size(spark, sf):
    return clean.dataset_size(views.functions(spark, sf))


@query(
    "has_p3",
    sql(
        "SELECT split, bool_or(status = 'NOT_VULNERABLE') AS has_unchanged FROM functions GROUP BY split",
        "functions",
    ),
)
def has_p3(spark, sf):
    return clean.has_unchanged(views.functions(spark, sf))
