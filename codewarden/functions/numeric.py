"""Column expressions on logits and probabilities, and per-row losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.binding import bind

LOG_GUARD = 1e-10
PAD_LABEL = -100
PAD_LOGIT = -10000.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    exps = bind(
        F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )
    return bind(
        exps, lambda e: bind(_sum(e), lambda total: F.transform(e, lambda x: x / total))
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def yes_probability(yes: Column, no: Column) -> Column:
    """First entry of the softmax over the two logits."""
    return sigmoid(yes - no)


def argmax_class(probs: Column) -> Column:
    """0-based index of the first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def log_softmax_at(logits: Column, label: Column) -> Column:
    def at(top: Column) -> Column:
        total = _sum(F.transform(logits, lambda x: F.exp(x - top)))
        return F.get(logits, label) - top - F.log(total)

    return bind(F.array_max(logits), at)


def cross_entropy(logits: Column, label: Column) -> Column:
    return -log_softmax_at(logits, label)


def focal_loss(
    logits: Column,
    label: Column,
    gamma: float = 2.0,
    alpha: float | Sequence[float] | None = None,
) -> Column:
    """Cross entropy damped by how sure the model is; ``alpha`` weighs the classes.

    One number ``a`` stands for the weights [a, 1 - a].
    """
    log_p = log_softmax_at(logits, label)
    loss = -F.pow(1.0 - F.exp(log_p), F.lit(float(gamma))) * log_p
    if alpha is None:
        return loss
    weights = [alpha, 1 - alpha] if isinstance(alpha, (int, float)) else list(alpha)
    return loss * F.get(F.array(*[F.lit(float(w)) for w in weights]), label)


def binary_log_loss(label: Column, prob: Column) -> Column:
    hit = label * F.log(prob + LOG_GUARD)
    miss = (1 - label) * F.log(1.0 - prob + LOG_GUARD)
    return -(hit + miss)


def bce_with_logits(logits: Column, labels: Column) -> Column:
    """Per-entry binary cross entropy of a multi-label row, in its overflow-safe form."""
    return F.zip_with(
        logits,
        labels,
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )


def reduce_loss(loss: Column, reduction: str = "mean", weight: Column | None = None) -> Column:
    """Aggregate of a row loss. With weights, the mean still divides by the number of rows."""
    value = loss if weight is None else loss * weight
    if reduction == "mean":
        return F.avg(value)
    if reduction == "sum":
        return F.sum(value)
    raise NotImplementedError(reduction)


def linear_head(
    vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None
) -> Column:
    """Logits of a linear layer: one weight row per class, as literals of the plan."""

    def logits(known: Column) -> Column:
        out = []
        for i, row in enumerate(weights):
            w = F.array(*[F.lit(float(x)) for x in row])
            dot = _sum(F.zip_with(known, w, lambda x, y: x.cast("double") * y))
            out.append(dot if bias is None else dot + float(bias[i]))
        return F.array(*out)

    return bind(vector, logits)
