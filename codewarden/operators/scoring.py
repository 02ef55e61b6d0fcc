"""Bulk scoring with any Python scorer, and a baseline classifier trained on Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.operators import curves
from codewarden.operators.metrics import best_run
from codewarden.support import materialize, pieces

Scorer = Callable[[pd.DataFrame], Sequence[float]]

#: What a weight, a gradient and an error of the baseline are whole numbers of: 1 / ONE.
ONE = 1 << 20
#: Length of the first step of the baseline's weights.
RATE = 0.5
#: Digits of the baseline's probabilities.
PROB_DIGITS = 6


def score_with(
    df: DataFrame,
    load: Callable[[], Scorer],
    inputs: Sequence[str],
    keep: Sequence[str] = ("idx",),
) -> DataFrame:
    """Score rows in pieces of Arrow batches: the kept columns, ``prob`` and ``error``.

    ``load`` runs once a task and returns the scorer. A batch that fails, or gives another number of
    scores than it has rows, is halved until the rows that fail by themselves are found; only
    they end up with an error and no probability. A NaN score is an error of its row.
    """
    columns = list(dict.fromkeys([*keep, *inputs]))
    narrow = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()

        def scored(rows: pd.DataFrame) -> list[tuple[float | None, str | None]]:
            try:
                found = [float(p) for p in scorer(rows)]
                if len(found) != len(rows):
                    raise ValueError(f"{len(found)} scores for {len(rows)} rows")
                return [(None, "score is NaN") if p != p else (p, None) for p in found]
            except Exception as failure:
                if len(rows) == 1:
                    return [(None, str(failure) or type(failure).__name__)]
                half = len(rows) // 2
                return scored(rows.iloc[:half]) + scored(rows.iloc[half:])

        for batch in chain.from_iterable(map(pieces, batches)):
            if not batch.num_rows:
                continue
            probs, errors = zip(*scored(_frame(batch.select(list(inputs)))))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(probs, pa.float64()), pa.array(errors, pa.string())],
                names=[*keep, "prob", "error"],
            )

    fields = [narrow.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return narrow.mapInArrow(run, f"{schema}, prob double, error string")


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch as pandas has it in Spark: dates as objects, times of the session without a zone."""
    rows = batch.to_pandas(date_as_object=True, maps_as_pydicts="lossy")
    zoned = [f.name for f in batch.schema if pa.types.is_timestamp(f.type) and f.type.tz]
    return rows.assign(**{c: rows[c].dt.tz_localize(None) for c in zoned})


def skip_count(scored: DataFrame) -> DataFrame:
    """Rows with and without a score."""
    return scored.agg(
        F.count("prob").alias("scored"), F.count_if(F.col("prob").isNull()).alias("skipped")
    )


def hashed_words(code: Column, features: int) -> Column:
    """The bucket of each word, by the first 32 bits of its MD5 digest."""
    number = lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10)
    return F.transform(
        text.word_tokens(F.coalesce(code, F.lit(""))),
        lambda word: (number(word).cast("long") % features).cast("int"),
    )


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values + 0.5).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's buckets once, with their counts and the length of the counts as a vector."""
    for batch in chain.from_iterable(map(pieces, batches)):
        words = batch.column("buckets").flatten().to_numpy()
        cuts = np.cumsum(batch.column("buckets").value_lengths().to_numpy())[:-1]
        found = [np.unique(w, return_counts=True) for w in np.split(words, cuts)]
        ends = np.cumsum([0, *(len(b) for b, _ in found)]).astype(np.int32)
        flat = lambda part: np.concatenate([np.zeros(0, np.int32), *part]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("split", "label", "weight")],
                pa.array([float(np.sqrt(np.sum(n.astype(np.int64) ** 2))) for _, n in found], pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(b for b, _ in found))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(n for _, n in found))),
            ],
            names=["split", "label", "weight", "norm", "buckets", "counts"],
        )


class _Rows:
    """A batch of counted rows as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.label = batch.column("label").to_numpy()
        self.weight = batch.column("weight").to_numpy()
        self.buckets = batch.column("buckets").flatten().to_numpy()
        self.counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
        sizes = batch.column("buckets").value_lengths().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        # Rows without words have no sum to divide.
        self.norm = np.maximum(batch.column("norm").to_numpy(), 1.0)

    def probs(self, weights: np.ndarray) -> np.ndarray:
        """Probability of label 1; the last of ``weights`` is the intercept."""
        sums = np.concatenate([[0], np.cumsum(weights[self.buckets] * self.counts)])
        margin = (weights[-1] + (sums[self.ends[1:]] - sums[self.ends[:-1]]) / self.norm) / ONE
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-margin))

    def gradient(self, weights: np.ndarray) -> np.ndarray:
        error = _whole(self.weight * (self.probs(weights) - self.label) * ONE)
        total = np.zeros(len(weights), np.int64)
        np.add.at(total, self.buckets, _whole(error[self.row] * self.counts / self.norm[self.row]))
        total[-1] = error.sum()
        return total


def _gradients(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Summed gradients of every setting, in one reading of ``rows``: a task sends its sums, and at most
    one number for each setting and bucket reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(weights)
        for batch in chain.from_iterable(map(pieces, batches)):
            part = _Rows(batch)
            total += np.stack([part.gradient(w) for w in weights])
        setting, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(setting.astype(np.int32)),
                pa.array(bucket.astype(np.int32)),
                pa.array(total[setting, bucket]),
            ],
            names=["setting", "bucket", "part"],
        )

    parts = rows.mapInArrow(task, "setting int, bucket int, part long")
    sums = parts.groupBy("setting", "bucket").agg(F.sum("part").alias("total")).toArrow()
    total = np.zeros_like(weights)
    place = sums.column("setting").to_numpy(), sums.column("bucket").to_numpy()
    total[place] = sums.column("total").to_numpy()
    return total


def _fitted(train: DataFrame, regularisation: np.ndarray, features: int, steps: int) -> np.ndarray:
    """Weights of every setting after ``steps`` steps, each as long as its gradient over the root of all
    its squared gradients so far; the intercept is not regularised."""
    weights = np.zeros((len(regularisation), features + 1), np.int64)
    squares = np.zeros(weights.shape)
    pull = np.repeat(regularisation[:, None], features + 1, axis=1)
    pull[:, -1] = 0.0
    mass = train.agg(F.sum(F.floor(F.col("weight") * ONE + 0.5).cast("long"))).first()[0]
    if not mass:
        return weights
    for _ in range(steps):
        slope = _gradients(train, weights) / (mass / ONE) + pull * weights
        squares += slope * slope
        moved = slope / np.sqrt(np.where(squares > 0, squares, 1.0))
        weights = weights - _whole(RATE * ONE * moved)
    return weights


def train_baseline(
    functions: DataFrame,
    regularisation: Sequence[float] = (0.0, 0.01, 0.1),
    features: int = 1 << 14,
    max_iter: int = 10,
    label: str = "target",
    weight: str | None = "weight",
) -> DataFrame:
    """Logistic regression on hashed words, ``max_iter`` steps for each regularisation; the setting with
    the best area under the ROC curve on ``valid`` is measured on ``test``.

    One row per setting: (run, epoch, reg, valid_auc, chosen, test_auc). Settings take the place
    of epochs, so the first of equal ones is chosen.

    Weights, errors and gradients are whole numbers of 1 / ONE, so sums do not depend on how rows are
    dealt, and a repeated or lost task changes nothing. All settings step together, and a step reads
    the written features once. Missing code has no words; a label other than 1 counts as 0; a missing
    weight is 0; without rows to train on all probabilities are a half.
    """
    number = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    words = functions.select(
        F.col("split").cast("string").alias("split"),
        F.when(F.col(label) == 1, 1).otherwise(0).alias("label"),
        number.alias("weight"),
        hashed_words(F.col("code"), features).alias("buckets"),
    )
    # Words and hashes once; every step and every measure reads the written features.
    counted = words.mapInArrow(
        _counted,
        "split string, label int, weight double, norm double, buckets array<int>, counts array<int>",
    )
    rows = materialize(counted, "features")
    settings = np.array(regularisation, float)
    weights = _fitted(rows.filter(F.col("split") == "train"), settings, features, max_iter)

    def probs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(pieces, batches)):
            part = _Rows(batch)
            for n, w in enumerate(weights):
                unit = 10.0**PROB_DIGITS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("split"),
                        pa.array(np.full(batch.num_rows, n + 1, np.int32)),
                        batch.column("label"),
                        pa.array(_whole(part.probs(w) * unit) / unit),
                    ],
                    names=["split", "epoch", "label", "prob"],
                )

    held = rows.filter(F.col("split").isin("valid", "test"))
    scored = held.mapInArrow(probs, "split string, epoch int, label int, prob double")
    table = curves.score_table(scored, keys=("epoch", "split"))
    # Two numbers per setting.
    area = {(r["epoch"], r["split"]): r["roc_auc"] for r in curves.roc_auc(table, ("epoch", "split")).collect()}
    tried = functions.sparkSession.createDataFrame(
        [
            ("baseline", n, float(reg), area.get((n, "valid")), area.get((n, "test")))
            for n, reg in enumerate(regularisation, 1)
        ],
        "run string, epoch int, reg double, valid_auc double, test_auc double",
    )
    best = best_run(tried.select("run", "epoch", F.col("valid_auc").alias("value"))).first()
    chosen = F.col("epoch") == (best["epoch"] if best else -1)
    # Only the chosen setting shows what it does on the test split.
    return tried.select(
        "run", "epoch", "reg", "valid_auc", chosen.alias("chosen"), F.when(chosen, F.col("test_auc")).alias("test_auc")
    )
