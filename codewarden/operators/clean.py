"""Row filters and column clean-up of labelled functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.functions import encoding, text
from codewarden.support import checked_score

# Fixed value: the only status with a meaning of its own, an unchanged function of a fixing commit.
NOT_VULNERABLE = "NOT_VULNERABLE"


def normalize_code(df: DataFrame, code: str = "code") -> DataFrame:
    return df.withColumn(code, text.normalize_whitespace(F.col(code)))


def cast_target(df: DataFrame, target: str = "target") -> DataFrame:
    return df.withColumn(target, F.col(target).cast("int"))


def truncate_or_drop(
    df: DataFrame, length: int, ignore_large: bool = False, tokens: str = "tokens"
) -> DataFrame:
    """Functions of ``length`` or more tokens are dropped, or cut to ``length - 1``."""
    if ignore_large:
        return df.filter(F.size(tokens) < length)
    return df.withColumn(tokens, encoding.truncate(F.col(tokens), length))


def drop_empty(df: DataFrame, code: str = "code") -> DataFrame:
    return df.filter(F.length(code) > 0)


def exclude_by_flag(df: DataFrame, flag: str | None) -> DataFrame:
    """Drop rows whose flag is set; no flag name keeps all rows."""
    if not flag:
        return df
    return df.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def drop_unchanged(df: DataFrame, status: str = "status") -> DataFrame:
    """Leave out the unchanged functions of fixing commits."""
    return df.filter(F.col(status) != NOT_VULNERABLE)


def status_as_class(df: DataFrame, cwe: str = "cwe", status: str = "status") -> DataFrame:
    return df.withColumn(
        "class", F.when(F.col(status) == NOT_VULNERABLE, NOT_VULNERABLE).otherwise(F.col(cwe))
    )


def status_weight(df: DataFrame, weight: float, status: str = "status") -> DataFrame:
    """1.0 for unchanged functions, ``weight`` for every other row."""
    return df.withColumn(
        "weight", F.when(F.col(status) == NOT_VULNERABLE, 1.0).otherwise(float(weight))
    )


def fits_context(
    df: DataFrame,
    limit: int,
    prompt: str = "prompt",
    tokenize: Callable[[Column], Column] = text.word_tokens,
) -> DataFrame:
    """Add ``fits``: the prompt stays below the limit with either answer appended."""

    def short(answer: str) -> Column:
        return F.size(tokenize(F.concat(F.col(prompt), F.lit(answer)))) < limit

    return df.withColumn("fits", short("YES") & short("NO"))


def valid_slots(df: DataFrame, labels: str = "labels", weights: str | None = None) -> DataFrame:
    """One row per used slot: label 0 or more, or for the loss a label and a positive weight."""
    if weights is None:
        slots = df.select("*", F.posexplode_outer(labels).alias("slot", "label"))
        return slots.filter(F.col("label") >= 0).drop(labels)
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(weights).alias("weight"))
    slots = df.select("*", F.posexplode_outer(pairs).alias("slot", "__pair"))
    return (
        slots.select("*", "__pair.label", "__pair.weight")
        .filter((F.col("label") != -100) & (F.col("weight") > 0))
        .drop(labels, weights, "__pair")
    )


def dataset_size(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def has_unchanged(df: DataFrame) -> DataFrame:
    """Per split, whether any unchanged function is in it."""
    return df.groupBy("split").agg(
        F.bool_or(F.col("status") == NOT_VULNERABLE).alias("has_unchanged")
    )


def align_predictions(examples: DataFrame, preds: DataFrame, key: str = "idx") -> DataFrame:
    """Join examples and predictions by key; a row without its partner, or with several, stops
    the job. Rows are counted per key by the shuffle that the join needs anyway."""
    times = F.count(F.lit(1)).over(W.partitionBy(key))
    both = examples.withColumn("__left", times).join(
        preds.withColumn("__right", times), key, "full_outer"
    )
    matched = (F.col("__left") == 1) & (F.col("__right") == 1)
    missing = F.col("__left").isNull() | F.col("__right").isNull()
    problem = F.concat(
        F.when(missing, "no partner").otherwise("several rows"),
        F.lit(f" for {key} "),
        F.coalesce(F.col(key).cast("string"), F.lit("null")),
    )
    return both.filter(F.when(matched, True).otherwise(F.raise_error(problem))).drop(
        "__left", "__right"
    )


def result_table(
    functions: DataFrame, preds: DataFrame, threshold: float = 0.5, key: str = "idx"
) -> DataFrame:
    """Score, truth, prediction and line count beside each test function; a missing or NaN score stops
    the job."""
    joined = align_predictions(functions, preds, key)
    # The prediction holds the check, and the column that shows the score is the checked one.
    score = checked_score(F.col("prob"), "prob")
    return joined.select(
        score.alias("logits"),
        F.col("target").alias("y_trues"),
        (score > threshold).alias("y_preds"),
        F.col(key).alias("index"),
        text.count_lines(F.col("code")).alias("num_lines"),
        "code",
    )
