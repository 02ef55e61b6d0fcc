"""The quality of all rows so far, at every so many input rows, of a table or of a stream's batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.operators.metrics import scores_from_counts
from codewarden.operators.ordered import ROWS_PER_RANGE, running_totals
from codewarden.operators.pairs import pair_gains
from codewarden.support import checked_score, materialize

CELLS = ("tn", "fp", "fn", "tp")
COUNTS = ("n", "skips", *CELLS)
MEASURES = ("accuracy", "precision", "recall", "f1")


@dataclass
class Carried:
    """What earlier rows leave behind: totals of ``COUNTS``, pairs won, and (score, pos, neg) of
    their distinct scores."""

    totals: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    won: float = 0.0
    scores: DataFrame | None = None


def _won_against(seen: DataFrame, scores: DataFrame, rows_per_range: int) -> DataFrame:
    """(step, more): pairs that rows (step, score, pos, neg) win against earlier (score, pos, neg)."""
    none = F.lit(0).cast("long")
    both = scores.unionByName(seen.select("score", none.alias("pos"), none.alias("neg")))
    at = both.groupBy("score").agg(F.sum("pos").alias("at_pos"), F.sum("neg").alias("at_neg"))
    upto = running_totals(
        at,
        ["score"],
        {"upto_pos": F.col("at_pos"), "upto_neg": F.col("at_neg")},
        grand={"upto_pos": "all_pos"},
        rows_per_range=rows_per_range,
    )
    below = F.col("upto_neg") - F.col("at_neg") / 2.0
    above = F.col("all_pos") - F.col("upto_pos") + F.col("at_pos") / 2.0
    won = F.sum(F.col("pos") * below + F.col("neg") * above)
    return seen.join(upto, "score").groupBy("step").agg(won.alias("more"))


def running_steps(
    preds: DataFrame,
    order: str = "idx",
    every: int = 100,
    label: str = "label",
    pred: str = "pred",
    skipped: str | None = None,
    score: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    since: Carried | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Totals of all rows so far, ``since`` included, at the end of each step of ``every`` rows
    that ``preds`` has rows of: (step, last, all_n, all_skips, ...), where ``last`` is the place of the
    step's last row. With ``score``, ``all_won`` and the rows' (score, pos, neg)."""
    since = since or Carried()
    skip = F.lit(False) if skipped is None else F.col(skipped)
    positive, flagged = F.col("__label") == 1, F.col("__pred") == 1
    counted = ~F.col("__skip")
    scored = [] if score is None else [F.when(~skip, checked_score(F.col(score))).alias("score")]
    # A row's place and the positives up to it.
    ranked = running_totals(
        preds.select(
            order, F.col(label).alias("__label"), F.col(pred).alias("__pred"), skip.alias("__skip"), *scored
        ),
        [order],
        {
            "__at": F.lit(1).cast("long"),
            "__positives": (counted & F.coalesce(positive, F.lit(False))).cast("long"),
        },
        rows_per_range=rows_per_range,
    ).withColumn("__at", F.col("__at") + since.totals["n"])
    ranked = ranked.withColumn("step", F.floor((F.col("__at") - 1) / every).cast("long"))
    of = {
        "tn": ~positive & ~flagged,
        "fp": ~positive & flagged,
        "fn": positive & ~flagged,
        "tp": positive & flagged,
    }
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("__skip").alias("skips")]
    counts += [F.count_if(counted & of[c]).alias(c) for c in CELLS]
    last = F.max("__at").alias("last")
    names = list(COUNTS)
    seen, most_steps = None, None
    if score is None:
        steps = ranked.groupBy("step").agg(*counts, last)
    else:
        # Positives before the step's first row: the least that a row has before itself.
        earlier = F.min(F.col("__positives") - (counted & positive).cast("long")).alias("earlier")
        by_score = materialize(ranked.groupBy("step", "score").agg(*counts, last, earlier), "running")
        size, last_step = by_score.agg(F.count(F.lit(1)), F.max("step")).first()
        steps = by_score.groupBy("step").agg(
            *[F.sum(name).alias(name) for name in COUNTS],
            F.max("last").alias("last"),
            F.min("earlier").alias("earlier"),
        )
        first_step = since.totals["n"] // every
        seen = by_score.select(
            (F.col("step") - first_step).alias("step"),
            "score",
            (F.col("tp") + F.col("fn")).alias("pos"),
            (F.col("tn") + F.col("fp")).alias("neg"),
        ).filter("pos + neg > 0")
        last_step = 0 if last_step is None else last_step - first_step
        gains = pair_gains(seen, size, last_step, every, rows_per_range)
        most_steps = last_step + 1
        won = F.coalesce("gain", F.lit(0.0)) + F.col("earlier") * (F.col("tn") + F.col("fp"))
        if since.scores is not None:
            gains = gains.join(_won_against(seen, since.scores, rows_per_range), "step", "left")
            won = won + F.coalesce("more", F.lit(0.0))
        gains = gains.withColumn("step", F.col("step") + first_step)
        steps = steps.join(gains, "step", "left").withColumn("won", won)
        names.append("won")
        seen = seen.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    summed = running_totals(
        steps,
        ["step"],
        {f"all_{c}": F.col(c) for c in names},
        rows_per_range=rows_per_range,
        most_rows=most_steps,
    )
    before = since.totals | {"won": since.won}
    summed = summed.withColumns({f"all_{c}": F.col(f"all_{c}") + F.lit(before[c]) for c in names})
    return summed.select("step", "last", *[f"all_{c}" for c in names]), seen


def reports(steps: DataFrame, every: int) -> DataFrame:
    """The reports of the steps that are complete."""
    s = scores_from_counts(*[F.col(f"all_{c}") for c in CELLS])
    area = []
    if "all_won" in steps.columns:
        positives = (F.col("all_tp") + F.col("all_fn")).cast("double")
        negatives = (F.col("all_tn") + F.col("all_fp")).cast("double")
        area = [(F.col("all_won") / F.nullif(positives * negatives, F.lit(0.0))).alias("roc_auc")]
    return steps.filter(F.col("last") == (F.col("step") + 1) * every).select(
        F.col("all_n").alias("rows_read"),
        F.col("all_skips").alias("rows_skipped"),
        *[s[m].alias(m) for m in MEASURES],
        *area,
    )


def running_report(preds: DataFrame, order: str = "idx", every: int = 100, **columns) -> DataFrame:
    """Quality over all rows so far, at every ``every``-th input row, in the order of ``order``.

    ``columns`` names ``label``, ``pred``, ``skipped`` and ``score`` (see :func:`running_steps`). Rows flagged
    by ``skipped`` count as input but not as predictions. With ``score``, the area under the ROC
    curve of all rows so far is given as well, null while a class is missing.
    """
    return reports(running_steps(preds, order, every, **columns)[0], every)
