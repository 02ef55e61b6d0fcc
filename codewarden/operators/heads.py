"""Pooling of token vectors and linear heads over vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import encoding, numeric


def apply_head(
    df: DataFrame,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
    vector: str = "vec",
) -> DataFrame:
    """Add ``logits`` and ``probs``: softmax for several classes, sigmoid for one."""
    scored = df.withColumn("logits", numeric.linear_head(F.col(vector), weights, bias))
    probs = (
        numeric.softmax(F.col("logits"))
        if len(weights) > 1
        else F.transform("logits", numeric.sigmoid)
    )
    return scored.withColumn("probs", probs)


def max_pool(
    vectors: DataFrame,
    mask: str | None = None,
    projection: Sequence[Sequence[float]] | None = None,
) -> DataFrame:
    """Largest value of each dimension over a function's token vectors.

    A masked vector is zeroed, not left out, and then projected like the others. The maximum is
    an aggregate of whole vectors, combined before the shuffle.
    """
    vec = F.transform("vec", lambda x: x.cast("double"))
    if mask is not None:
        vec = F.transform(vec, lambda x: F.when(F.col(mask) == 1, x).otherwise(0.0))
    if projection is not None:
        vec = numeric.linear_head(vec, projection)
    pooled = Summarizer.max(array_to_vector("vec"))
    return (
        vectors.select("func_id", vec.alias("vec"))
        .groupBy("func_id")
        .agg(vector_to_array(pooled).alias("vec"))
    )


def cls_pool(vectors: DataFrame) -> DataFrame:
    """Vector of the first token."""
    return vectors.filter(F.col("pos") == 0).select("func_id", "vec")


def segment_ends(sequences: DataFrame, separator: int, ids: str = "ids") -> DataFrame:
    """(seq_id, segment, pos): where each function of a sequence ends."""
    ends = encoding.segment_ends(F.col(ids), separator)
    rows = sequences.select("seq_id", F.posexplode_outer(ends).alias("segment", "pos"))
    return rows.filter(F.col("pos").isNotNull())


def last_token_pool(
    vectors: DataFrame, sequences: DataFrame, separator: int, ids: str = "ids"
) -> DataFrame:
    """Vector at each segment end: (seq_id, segment, pos, vec)."""
    return segment_ends(sequences, separator, ids).join(
        vectors.select("seq_id", "pos", "vec"), ["seq_id", "pos"]
    )
